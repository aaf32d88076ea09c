"""The logical views of ``views`` as DuckDB SQL, for checking results.

Scores are rounded as decimals: like Spark, halves of the written number go up.
"""

from __future__ import annotations

PARSED_HOUR = """CASE WHEN regexp_full_match(regexp_replace(trim({0}), '\\.0$', ''), '[0-9]{{8}}')
    THEN try_strptime(regexp_replace(trim({0}), '\\.0$', ''), '%y%m%d%H')
    WHEN regexp_matches(trim({0}), '^[0-9]{{4}}-') THEN try_cast(trim({0}) AS TIMESTAMP) END"""

_TIER = "list_extract(['sfw', 'suggestive', 'mature', 'unknown'], (({0}) % 4 + 1)::INTEGER)"

VIEWS = {
    "impressions": """
    SELECT event_id::VARCHAR AS id, strftime(ts, '%y%m%d%H') AS hour,
      (event_type = 'click')::INTEGER::DOUBLE AS click, (k % 4)::VARCHAR AS banner_pos,
      'site' || k AS site_id, 'sd' || (k % 10) AS site_domain, 's' || (k % 5) AS site_category,
      'app' || (event_id % 50) AS app_id, 'ad' || (event_id % 10) AS app_domain, 'a' || (k % 7) AS app_category,
      'dev' || user_id AS device_id, 'ip' || (event_id % 1000) AS device_ip, 'm' || (user_id % 20) AS device_model,
      (k % 3)::VARCHAR AS device_type, (event_id % 4)::VARCHAR AS device_conn_type,
      '1005' AS C1, floor(value)::BIGINT::VARCHAR AS C14, '320' AS C15, '50' AS C16, k::VARCHAR AS C17,
      (k % 4)::VARCHAR AS C18, (user_id % 7)::VARCHAR AS C19, (event_id % 9)::VARCHAR AS C20,
      (event_id % 11)::VARCHAR AS C21, user_id::VARCHAR AS character_id,
      (event_id % 12)::DOUBLE AS conversation_turn, (event_id % 20)::DOUBLE AS session_msg_count, value
    FROM (SELECT *, json_extract_string(props, '$.k')::INTEGER AS k FROM events)""",
    "characters": f"""
    SELECT CASE WHEN c_custkey % 10 = 9 THEN 'retired-' || c_custkey ELSE c_custkey::VARCHAR END AS character_id,
      c_name AS character_name, 'about ' || c_name AS character_description,
      {_TIER.format('c_nationkey + 2 - version')} AS safety_tier, c_mktsegment AS creator_type,
      c_acctbal AS num_interactions,
      strftime(DATE '2023-12-25' + (c_custkey % 40)::INTEGER, '%Y-%m-%d') AS created_at, version
    FROM customer, (VALUES (1), (2)) AS v(version)""",
    "dirty": """
    SELECT * REPLACE (
      CASE WHEN e % 97 = 0 THEN NULL WHEN e % 101 = 0 THEN 'bad' ELSE hour END AS hour,
      CASE WHEN e % 103 = 0 THEN 2.0 ELSE click END AS click,
      CASE WHEN e % 107 = 0 THEN ' ' WHEN e % 109 = 0 THEN ' x ' ELSE app_category END AS app_category,
      CASE WHEN e % 113 = 0 THEN 'None' ELSE site_category END AS site_category,
      CASE WHEN e % 127 = 0 THEN NULL ELSE character_id END AS character_id,
      CASE WHEN e % 131 = 0 THEN -3.0 ELSE conversation_turn END AS conversation_turn,
      CASE WHEN e % 137 = 0 THEN NULL ELSE session_msg_count END AS session_msg_count)
    FROM (SELECT *, id::BIGINT AS e FROM impressions)""",
    "dedup": """
    SELECT * FROM characters QUALIFY row_number() OVER (PARTITION BY character_id ORDER BY version DESC) = 1""",
    "joined": f"""
    SELECT i.* EXCLUDE (character_id), coalesce(i.character_id, 'unknown') AS character_id,
      {PARSED_HOUR.format('i.hour')} AS event_timestamp,
      d.character_name, d.safety_tier, d.creator_type, d.num_interactions, d.created_at::TIMESTAMP AS created_at
    FROM impressions i LEFT JOIN dedup d ON coalesce(i.character_id, 'unknown') = d.character_id""",
    "featured": """
    SELECT *, CASE WHEN messages > 0 THEN turn / messages ELSE 0 END AS turn_ratio,
      coalesce(extract(hour FROM event_timestamp), -1) AS hour_of_day,
      coalesce(isodow(event_timestamp) - 1, -1) AS day_of_week,
      coalesce(isodow(event_timestamp) >= 6, false)::INTEGER AS is_weekend,
      greatest(coalesce(num_interactions, 0), 0) AS interactions,
      greatest(coalesce(date_sub('day', created_at, event_timestamp), 0), 0)::DOUBLE AS age_days,
      coalesce(safety_tier, 'unknown') AS tier, coalesce(creator_type, 'unknown') AS creator
    FROM (SELECT *, greatest(coalesce(conversation_turn, 0), 0) AS turn,
      greatest(coalesce(session_msg_count, 0), 0) AS messages FROM joined)""",
    "scored": """
    SELECT id, character_id, tier AS safety_tier, creator AS creator_type, app_category, turn AS conversation_turn,
      click::INTEGER AS y, least(value / 500, 1.0) AS p,
      CASE WHEN id::BIGINT % 3 = 0 THEN 'validation' ELSE 'test' END AS split
    FROM featured""",
    "drift": """
    SELECT *, row_number() OVER (ORDER BY event_timestamp NULLS LAST, hour NULLS LAST, id NULLS LAST) - 1 AS pos,
      count(*) OVER () AS total,
      list_extract(['early', 'middle', 'latest'], (least(2, floor(pos * 3 / total)) + 1)::INTEGER) AS period,
      least(greatest(coalesce(click, 0), 0), 1) AS clicked,
      coalesce(strftime(event_timestamp, '%Y-%m-%d'), 'unknown') AS event_day,
      coalesce(strftime(event_timestamp, '%Y-%m-%d %H:00'), 'unknown') AS event_hour_bucket
    FROM featured""",
    "contexts": f"""
    SELECT o_orderkey::VARCHAR AS request_id, o_custkey::VARCHAR AS character_id, {_TIER.format('o_orderkey')} AS safety_tier,
      CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS app_category,
      CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END AS site_category,
      '9' AS banner_pos, (o_orderkey % 6)::VARCHAR AS C14,
      (o_orderkey % 12)::DOUBLE AS conversation_turn, (o_orderkey % 20)::DOUBLE AS session_msg_count
    FROM orders""",
    "candidates": f"""
    SELECT l_orderkey::VARCHAR AS request_id,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice,
        l_quantity, l_shipdate) - 1 AS pos,
      count(*) OVER (PARTITION BY l_orderkey) AS n,
      coalesce(CASE WHEN l_partkey % 5 <> 0 THEN 'part' || l_partkey END, 'candidate-' || (pos + 1)) AS candidate_id,
      CASE WHEN p_size % 2 = 0 THEN (p_size % 8)::VARCHAR END AS banner_pos, p_size::VARCHAR AS C14,
      {_TIER.format('p_size')} AS tier, p_size % 10 AS fatigue,
      CASE WHEN l_partkey % 30 = 0 THEN 1.0 ELSE (l_partkey % 30) / 15.0 END AS pacing
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""",
    "fallback": """
    SELECT *, round(least(greatest(0.05::DOUBLE * CASE WHEN app_category IS NOT NULL THEN 1.05::DOUBLE ELSE 1 END
        * CASE WHEN site_category IS NOT NULL THEN 1.03::DOUBLE ELSE 1 END
        * CASE WHEN session_msg_count > 0 AND conversation_turn / session_msg_count <= 0.25 THEN 1.02::DOUBLE
               WHEN session_msg_count > 0 THEN 0.98::DOUBLE ELSE 1 END, 0.0001), 0.9999)::VARCHAR::DECIMAL(38, 20), 6)::DOUBLE AS predicted_ctr,
      array_to_string(list_filter(['fallback global CTR prior',
        CASE WHEN app_category IS NOT NULL THEN 'app category available' END,
        CASE WHEN site_category IS NOT NULL THEN 'site category available' END,
        CASE WHEN session_msg_count > 0 AND conversation_turn / session_msg_count <= 0.25 THEN 'early session context'
             WHEN session_msg_count > 0 THEN 'later session context' END], lambda x: x IS NOT NULL), '|') AS reasons
    FROM contexts""",
    "ranked": """
    SELECT request_id, pos AS "position", candidate_id, predicted_ctr, final_score, reasons,
      row_number() OVER (PARTITION BY request_id ORDER BY final_score DESC, pos) AS rank
    FROM (SELECT request_id, pos, candidate_id, predicted_ctr,
      round((predicted_ctr * CASE WHEN tier = safety_tier AND tier <> 'unknown' THEN 1.05::DOUBLE ELSE 1 END
        * CASE WHEN pacing > 1 THEN greatest(0.5, 1.0 / pacing) WHEN pacing >= 0 AND pacing < 0.8 THEN 1.05::DOUBLE ELSE 1 END
        * CASE WHEN fatigue <= 3 THEN 1 ELSE greatest(0.3::DOUBLE, 1.0::DOUBLE - (fatigue - 3) * 0.12::DOUBLE) END
        * CASE WHEN fatigue = 0 AND predicted_ctr < 0.08 THEN 1.03::DOUBLE ELSE 1 END)::VARCHAR::DECIMAL(38, 20), 8)::DOUBLE AS final_score,
      f.reasons || '|' || CASE WHEN pacing > 1 THEN 'pacing reduced overspending campaign'
          WHEN pacing >= 0 AND pacing < 0.8 THEN 'pacing boosted underspending campaign' ELSE 'pacing on target' END
        || '|' || CASE WHEN fatigue <= 3 THEN 'fatigue within cap' ELSE 'fatigue penalty applied' END
        || '|' || CASE WHEN fatigue = 0 AND predicted_ctr < 0.08 THEN 'under-explored candidate bonus' ELSE 'no exploration bonus' END
        || CASE WHEN tier = safety_tier AND tier <> 'unknown' THEN '|safe tier match' ELSE '' END AS reasons
      FROM candidates c JOIN fallback f USING (request_id)
      WHERE n <= 200 AND NOT (safety_tier = 'sfw' AND tier = 'mature'))""",
}

# The views each view reads.
_NEEDS = {
    "dirty": ["impressions"], "dedup": ["characters"], "joined": ["impressions", "dedup"],
    "featured": ["joined"], "scored": ["featured"], "drift": ["featured"], "fallback": ["contexts"],
    "ranked": ["candidates", "fallback"],
}


def with_views(names: list[str], body: str, dirty: bool = False) -> str:
    """``body`` after the named views and what they read; ``dirty`` puts the defective impressions below them."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add("dirty" if dirty and need == "impressions" and name != "dirty" else need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    parts = []
    for name in ordered:
        sql = VIEWS[name]
        if dirty and name == "joined":
            sql = sql.replace("FROM impressions i", "FROM dirty i")
        parts.append(f"{name} AS ({sql})")
    return "WITH " + ",\n".join(parts) + "\n" + body

import hashlib
import random
import re

from hypothesis import given, settings, strategies as st

from clickloom.llm import infill

PLAN = infill.Plan()


def plain_version(text, name, seed=1):
    """The contract step by step on strings."""
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(tokens)
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:low]), "".join(tokens[low:high]), "".join(tokens[high:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab Z<>PSM\n\0é漢😀"), st.characters(exclude_categories=["Cs"]))), st.integers(0, 500))
def test_equals_the_plain_version_and_comes_back(text, name):
    n, form, before, middle, output = infill.transform_text(text.encode(), str(name), PLAN)
    assert (n, form, before, middle, output.decode()) == plain_version(text, name)
    assert infill.restore_text(output, form) == text.encode()


def test_all_forms_of_odd_texts(spark):
    texts = ["", None, "a", "<", "<P", "x<P>y", "<<SS>>", "one two three", "漢字 é😀" * 50, "A" * 300_000, "a b " * 200_000, "<S" * 3000]
    rows = [(i, texts[i % len(texts)], "n", "output", 7) for i in range(40 * len(texts))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string, form string, output int")
    made = infill.fill_in_middle(docs)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = {row.doc_id: tuple(row)[1:] for row in made.collect()}
    assert got == {row[0]: plain_version(row[1], row[0]) for row in rows}
    assert {row[1] for row in got.values()} == {"plain", "psm", "spm"}
    back = {row.doc_id: row.restored for row in infill.restored(made).collect()}
    assert back == {row[0]: row[1] or "" for row in rows}


def test_repeated_and_null_ids_and_an_empty_table(spark):
    docs = spark.createDataFrame([("a b c d", 5), ("a b c d", 5), ("a b c d", None)], "text string, doc_id int")
    rows = infill.fill_in_middle(docs).collect()
    assert rows[0] == rows[1] and rows[0].output == plain_version("a b c d", 5)[4]
    assert rows[2].doc_id is None and rows[2].output == plain_version("a b c d", "")[4]
    assert infill.restored(infill.fill_in_middle(docs.limit(0))).count() == 0


def test_rates_and_seed_are_followed(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('word ', id, ' and more') AS text")
    forms = {row.form: row["count"] for row in infill.fill_in_middle(docs, infill.Plan(seed=3, rate=50, spm_rate=100)).groupBy("form").count().collect()}
    assert set(forms) == {"plain", "spm"} and 880 < forms["spm"] < 1120


def test_starts_are_those_of_the_tokens():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("abZ é漢😀\n.1") for _ in range(rng.randrange(1, 40)))
        starts = infill.token_starts(infill.np.frombuffer(text.encode(), dtype=infill.np.uint8))
        want = [len(text[: m.start()].encode()) for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)]
        assert starts.tolist() == want

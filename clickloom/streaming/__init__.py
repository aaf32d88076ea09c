"""The stateless operators on streams, and windowed click rates."""

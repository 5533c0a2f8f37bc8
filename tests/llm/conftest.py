import pytest

#: Columns that clash with names that operators use inside.
EXTRA = {"row": 1, "id": 2, "size": 3, "key": "k", "spans": "s", "range": 4, "label": 5, "score": 0.1, "fp": 6, "norm": "n", "hash": 7, "n": 8, "part": 9, "kind": 10, "draw": "d", "target": 1.5}


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table of (doc_id, text) or (doc_id, text, source) rows, with nulls as given and clashing columns."""

    def make(rows, extra=True):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else None, None if r[1] is None else len(r[1])) + (tuple(EXTRA.values()) if extra else ()) for r in rows]
        kinds = {int: "long", float: "double", str: "string"}
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        if extra:
            schema += "".join(f", `{k}` {kinds[type(v)]}" for k, v in EXTRA.items())
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank, repeated and very long texts, null and repeated ids."""
    long = " ".join(f"word{i % 977} some{i % 31}" for i in range(60_000))
    return [
        (1, None, None), (2, "", "a"), (3, " \t\n\x0b\f\r ", "a"), (4, "one", "b"), (5, "one", "b"), (5, "one", "b"), (5, "two words", None),
        (None, "one", "c"), (None, None, None), (6, long, "b"), (7, long + " end", "c"), (8, "é" * 200 + " ß 📚", "ü"), (9, "o n\ne", "a"),
    ]

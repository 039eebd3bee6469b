import pyarrow as pa
import pyarrow.parquet as pq
import pytest

LONG = " ".join(f"palabra{i % 97}" for i in range(6000))
#: Odd rows that every operator must take: nulls, empty and blank texts, repeats, a very long text.
ODD = [
    (0, None, "en", "a", None),
    (1, "", "en", None, 0),
    (2, " \n\t ", None, "a", 4),
    (3, "One two three.", "en", "a", 14),
    (4, "One two three.", "en", "a", 14),
    (5, "one TWO three.", "en", "b", 14),
    (6, LONG, "es", "b", len(LONG)),
    (7, "ÀÉ straße 漢字 \U0001f600 x", "fr", "c", 18),
    (None, "no key here", "en", "c", 11),
]
DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])


@pytest.fixture
def write(tmp_path):
    """Writes rows as a table of a data directory and returns that directory."""

    def put(name, rows, schema=DOCS, folder="data", **more):
        (at := tmp_path / folder).mkdir(exist_ok=True)
        columns = {f.name: pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)} | {k: pa.array([v] * len(rows)) for k, v in more.items()}
        pq.write_table(pa.table(columns), at / f"{name}.parquet")
        return str(at)

    return put


def documents(texts):
    return [(i, t, "en", "a", None if t is None else len(t)) for i, t in enumerate(texts)]

import unicodedata

import pytest
from pyspark.sql import functions as F

from siltbed.functions import text as T
from siltbed.sources import markdown as M


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize("a, b", [("كتاب", "کتاب"), ("۱۲۳ ٤٥", "123 45"), ("می‌شود", "می شود"), ("ﬁn", "fin"), ("Straße", "strasse"), ("إ أ ؤ ة", "ا ا و ه"), ("ۀ", "هٔ")])
def test_equal_normal_forms(spark, a, b):
    assert one(spark, a, T.normalize) == one(spark, b, T.normalize)


@pytest.mark.parametrize("x", ["  A\tB\n ", "ÀÉ ß", "x\x1cy", "Ⅷ ㍿", "İi", "", None])
def test_normal_form_equals_definition(spark, x):
    want = None if x is None else " ".join(unicodedata.normalize("NFKC", x).split()).casefold()
    assert one(spark, x, T.normalize) == want


def test_terms(spark):
    assert one(spark, "Connect Node.js (and Postgres)? a node", T.search_terms) == ["connect", "nodejs", "and", "postgresql"]
    assert one(spark, None, T.search_terms) is None
    assert one(spark, "?!", T.search_query) == "?!"


def test_trigrams(spark):
    assert sorted(one(spark, "cat cat", T.trigrams)) == sorted(["  c", " ca", "cat", "at "])


def test_redaction(spark):
    safe = one(spark, 'DB_PASSWORD="p" x\nTOKEN=abc\nBearer abcdefghijklm\nredis://u:pw@h', T.redact)
    assert safe == 'DB_PASSWORD="<YOUR_DB_PASSWORD>" x\nTOKEN=abc\nBearer <YOUR_TOKEN>\nredis://u:<YOUR_PASSWORD>@h'
    assert one(spark, safe, T.redact) == safe
    long = "data:image/png;base64," + "a" * 1024
    assert one(spark, long, T.redact) == "data:image/png;base64,<REDACTED_EMBEDDED_ASSET>"


def test_pieces(spark):
    assert one(spark, "abcdefg", lambda c: T.pieces(c, 3)) == ["abc", "def", "g"]
    assert one(spark, "", T.pieces) == []


def test_units(spark):
    rows = spark.createDataFrame([("# A\n### C\ntext\n~~~py\nx\n~~~\n- ```sh\nls\n```\nend\n```\nopen",), ("x\n```\n",)], "content string")
    units, small = (r.units for r in M.with_units(rows).collect())
    assert [u["kind"] for u in units] == ["heading", "heading", "text", "code", "code", "text", "code"]
    assert units[2]["heading_path"] == ["A", "C"] and units[3]["code_language"] == "py"
    assert units[-1]["content"].endswith("```")
    assert [(u.heading_path, u.content, u.kind, u.code_language) for u in small] == [([], "x", "text", None)]


def test_chunks_hold_their_limits(spark):
    text = "\n\n".join(f"paragraph {i} " + "word " * 60 for i in range(30)) + "\n```py\n" + "x = 1\n" * 400 + "```\n\n" + "z" * 9000
    chunks = M.chunked(spark.createDataFrame([("d", text)], "stable_id string, content string")).orderBy("ordinal").collect()
    code = [c for c in chunks if c["code_languages"]]
    assert len(code) == 1 and code[0]["content"].count("x = 1") == 400
    assert all(c["token_count"] <= 700 for c in chunks if not c["code_languages"])
    assert [c["ordinal"] for c in chunks] == list(range(len(chunks)))


def test_repeated_chunks_have_their_own_ids(spark):
    content = "\n\n".join(["same " * 500] * 3)
    rows = M.chunked(spark.createDataFrame([("d", content)], "stable_id string, content string")).collect()
    assert len({r.chunk_id for r in rows}) == len(rows) > 1


def test_scan(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_bytes(b"\xef\xbb\xbfOriginal link: https://docs.example.com/x\n# T\nbody")
    files = M.scan(spark, str(tmp_path))
    docs, chunks = M.ingested(files, "docs.example.com")
    assert docs.first().status == "ok" and chunks.count() == 1

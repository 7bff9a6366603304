"""Every stage of the pipeline against a brute-force version, on the stage's own input."""

import re
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline as P
from millrace.llm.entry import MIX, REST
from millrace.llm.quality import classify

from .test_jaccard_join import brute as components
from .test_mixing import brute as mixed
from .test_token_output import plain

SF = "/root/testdata/sf0.001"


def words(text):
    return [w for w in (re.sub(r"^[^\w]+|[^\w]+$", "", x.lower()) for x in (text or "").split()) if w]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, states = docs.columns, [docs]
    for i, (_, stage) in enumerate(P.STAGES):
        stage(spark, states[-1], SF).write.parquet(str(tmp_path / str(i)))
        states.append(spark.read.parquet(str(tmp_path / str(i))))
        if i < len(P.STAGES) - 1:
            assert states[-1].columns == columns
    rows = [s.collect() for s in states]
    ids = [sorted(r.doc_id for r in x) for x in rows]
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    assert ids[1] == sorted(r.doc_id for r in classify(docs, labels).collect() if r.predicted == 1)
    assert ids[2] == [d for d, _, c in components([(r.doc_id, r.text) for r in rows[1]], 5, 80, 100) if d == c]
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {r.doc_id for r in rows[2] if any(f" {' '.join(i)} " in f" {' '.join(words(r.text))} " for i in items)}
    assert ids[3] == [d for d in ids[2] if d not in held]
    assert ids[4] == ids[3]
    order = [m[0] for m in sorted(mixed([(r.doc_id, r.source) for r in rows[3]], MIX, REST, 32, 100), key=lambda m: (m[3], m[4], m[1]))]
    texts, at = {r.doc_id: r.text for r in rows[3]}, 0
    found = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows[5]}
    for d in order:
        tokens = plain(texts[d])
        assert found[d] == (at, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes()))
        at += len(tokens)
    assert len(found) == len(order) == len(rows[5])


def test_run_equals_the_stages(spark):
    rows = P.run(spark, SF).collect()
    assert rows and len({r.doc_id for r in rows}) == len(rows)
    assert sum(r.n_tokens for r in rows) == max(r.start + r.n_tokens for r in rows)


@pytest.mark.parametrize("rows", [[], [(1, None, "en", "src0", None, "x"), (None, "", None, None, 0, "x"), (2, "one", "en", "src9", 3, None), (2, "one", "en", "src9", 3, None), (3, " \n", "de", None, 2, "y"), (None, "word " * 50_000, "en", "src1", 250_000, "z")]])
def test_odd_rows_pass_every_stage(spark, rows, tmp_path):
    """Nulls, empty and long texts, repeated rows and no rows, with columns that operators use themselves."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string")
    docs = docs.withColumns({c: docs.node for c in ("score", "component", "gone", "rep", "slot", "place", "part", "digest")})
    judged = P.quality(spark, docs, SF)
    assert judged.columns == docs.columns and judged.count() <= len(rows)
    for i, (_, stage) in enumerate(P.STAGES[1:], 1):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        got = spark.read.parquet(str(tmp_path / str(i)))
        if i < len(P.STAGES) - 1:
            assert got.columns == docs.columns and got.count() == len(rows)  # nothing here has a copy under another id
            docs = got
        else:
            assert got.count() == len(rows)
    kept = P.quality(spark, spark.read.parquet(f"{SF}/documents.parquet").withColumns({"score": P.F.lit("s"), "_score": P.F.lit("t"), "__Score": P.F.lit("u")}), SF)
    assert kept.columns[-3:] == ["score", "_score", "__Score"] and kept.count() > 0 and kept.where("score <> 's' OR _score <> 't' OR __Score <> 'u'").isEmpty()

import hashlib

import tiktoken

import corpus_pipeline
from spanpref.llm import bpe, decontaminate, queries, toxicity
from spanpref.llm.common import components
from spanpref.llm.simhash import fingerprint

SF = "/root/testdata/sf0.001"


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(5000, 5000), (None, 3), (7000, 6000), (6000, 7000)]
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components(frame).collect()}
    want = {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(400)} | {6000: 6000, 7000: 6000}
    assert got == want


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    (_, tox), (_, dup), (_, dec), (_, mask), (_, enc) = corpus_pipeline.STAGES
    one = tox(spark, docs, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bad = {r.doc_id for r in toxicity.result(docs, labels).where("predicted = 1").collect()}
    left = {d: t for d, t in rows.items() if d not in bad}
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == set(left)
    two = dup(spark, one, SF)
    fps = {d: fingerprint(t) for d, t in left.items()}
    kept = set()
    todo = sorted(left)
    seen = set()
    for d in todo:
        if d not in seen:
            kept.add(d)
            queue = [d]
            while queue:
                x = queue.pop()
                if x not in seen:
                    seen.add(x)
                    queue += [y for y in todo if y not in seen and bin(fps[x] ^ fps[y]).count("1") <= 2]
    assert {r.doc_id for r in two.collect()} == kept
    three = dec(spark, two, SF)
    items = [decontaminate.normal(r.text)[0].strip() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {d for d in kept if not any(i in decontaminate.normal(rows[d])[0] for i in items)}
    assert {r.doc_id for r in three.collect()} <= clean and three.count() >= 0.98 * len(clean)
    four = mask(spark, three, SF)
    assert four.columns == docs.columns and four.count() == three.count()
    texts = {r.doc_id: r.text for r in four.collect()}
    c = bpe.codec(*bpe.default_vocabulary())
    tik = tiktoken.Encoding("own", pat_str=bpe.default_vocabulary()[1], mergeable_ranks=c.ranks, special_tokens={})
    for r in enc(spark, four, SF).collect():
        ids = tik.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.decoded_sha256) == (len(ids), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_run_and_registry(spark):
    import __spark_entry__ as E

    assert corpus_pipeline.run(spark, SF).count() > 100
    names = [f"op{n}_" for n in range(1, 11)]
    assert all(any(q.startswith(n) for q in queries.QUERIES) for n in names)
    assert set(queries.QUERIES) | {"pipeline"} <= set(E.queries())


def test_empty_tables_pass_through(spark, messy, empty, tmp_path):
    for name, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    for docs in (messy, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == messy.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()

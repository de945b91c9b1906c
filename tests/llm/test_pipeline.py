"""Every stage of the pipeline on what the one before kept, against brute force."""

import hashlib
from collections import Counter

import corpus_pipeline
from factline.llm import langid, mixing
from tests.llm.test_decontaminate import lcs_brute
from tests.llm.test_jaccard import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(90_001, None, None, None, None), (90_002, "", "en", "src0", 0), (90_003, "12345 67890", "en", "src0", 11), (None, "the and of " * 30, "en", None, 5)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.select(columns).collect()]
        docs.write.parquet(str(tmp_path / f"{k}-in"))
        out = stage(spark, spark.read.parquet(str(tmp_path / f"{k}-in")), SF)
        out.write.parquet(str(tmp_path / f"{k}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}"))
        after = [tuple(r) for r in docs.select(columns).collect()]
        if k < 4:
            assert docs.columns == columns
        if k == 0:
            gone = {r[0] for r in before} - {r[0] for r in after}
            assert gone == {90_001, 90_002, 90_003}
            assert Counter(r["accepted"] for r in langid.language_mixture(spark.read.parquet(str(tmp_path / "0-in"))).collect())[False] == 3
        elif k == 1:
            root = {r[0]: r[0] for r in before if r[0] is not None}
            for a, b in brute([(r[0], r[1]) for r in before]):
                x, y = sorted((root[a], root[b]))
                root = {i: x if v == y else v for i, v in root.items()}
            assert sorted(map(repr, after)) == sorted(repr(r) for r in before if r[0] is None or root[r[0]] == r[0])
        elif k == 2:
            def leaks(text):
                w = text.lower().replace(".", " ").replace(",", " ").split()
                for t in items.values():
                    i = t.lower().replace(".", " ").replace(",", " ").split()
                    step = max(1, len(i) // 4)
                    if any(lcs_brute(i, w[max(0, at - 4) : at + len(i) + step + 4]) >= 0.85 * len(i) for at in range(0, len(w), step) if set(i[-3:]) & set(w[at : at + len(i) + step])):
                        return True
                return False

            short = [r for r in before if len(r[1]) < 4000]
            kept = {repr(r) for r in after}
            assert all((repr(r) in kept) != leaks(r[1]) for r in short)
            assert kept <= set(map(repr, before))
        elif k == 3:
            n = Counter(r[3] for r in before)
            total, w = len(before), {s: c**mixing.TEMPERATURE for s, c in n.items()}
            want = Counter()
            for r in before:
                u = (int(hashlib.md5(f"{mixing.SEED}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                want[repr(r)] += mixing.poisson(total * w[r[3]] / sum(w.values()) / n[r[3]], u)
            assert Counter(map(repr, after)) == +want
        else:
            assert sorted(map(repr, after)) == sorted(map(repr, before))
            at = Counter((r["shard"], r["position"]) for r in docs.collect())
            assert max(at.values()) == 1


def test_run_equals_the_stages(spark):
    a = corpus_pipeline.run(spark, SF)
    assert a.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "position"]
    assert a.count() > 100
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()), key=repr)


def test_stages_on_empty_tables_and_clashing_names(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.selectExpr("*", "doc_id % 3 AS copy_no", "'x' AS shuffle_key", "1 AS `m.n`", "'en' AS Keeper", "2 AS c1", "3 AS __gone", "4 AS n").limit(60)
    odd.write.parquet(str(tmp_path / "odd"))
    odd = spark.read.parquet(str(tmp_path / "odd"))
    own = {tuple(r) for r in odd.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.limit(0), SF).collect() == [], name
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns + ["shard", "position"] * (k == 4), name
        rows = [tuple(r)[: len(odd.columns)] for r in out.collect()]
        assert rows and set(rows) <= own, name

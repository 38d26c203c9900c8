"""Mixing, and the pipeline as a whole against a brute-force version."""

from collections import defaultdict

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import decontaminate, mixing, quality, secrets


def brute_targets(sizes):
    """Reshares what is above a cap until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    left, open_, target = sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            open_.discard(s)
        left = sum(sizes.values()) - sum(target.values())
    return target


def totals(rows, got):
    source = {}
    for i, t, _, s in rows:
        source[i] = s
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        s = source[r.doc_id]
        sizes[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
    return sizes, taken, target


@pytest.mark.parametrize("bucket", [20_000, 7])
def test_mix_meets_its_targets(make_docs, sample_rows, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    rows = sample_rows + [(7000 + k, "w " * (k % 9), "en", "hot") for k in range(150)] + [(8000, "tiny", "en", "a"), (8001, "no source", "en", None), (8002, None, "en", "empty")]
    docs = make_docs(rows, clashing=True)
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(rows)
    sizes, taken, target = totals(rows, got)
    want = brute_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]), s
        largest = max([r.size for r in got if dict((x[0], x[3]) for x in rows)[r.doc_id] == s])
        assert abs(taken[s] - want[s]) <= largest
    assert all(r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in got)
    again = mixing.mix_report(docs.repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_odd_rows_and_empty(make_docs, odd_rows):
    docs = make_docs(odd_rows, clashing=True)
    assert mixing.mix_report(docs).count() == len(odd_rows)
    assert mixing.mix_report(make_docs([])).collect() == [] and mixing.mixed(make_docs([])).collect() == []
    got = mixing.mixed(docs).collect()
    assert all(r.copies > 0 and r.taken == r.copies * len((r.text or "").encode().split()) for r in got)


@pytest.mark.parametrize("doc_id", [7, None])
def test_equal_rows_are_rounded_one_by_one(make_docs, monkeypatch, doc_id):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    rows = [(doc_id, "ten words " * 5, "en", "a")] * 500 + [(k, "two words", "en", "b") for k in range(1000, 1400)] + [(doc_id, f"{k} nine " * 5, "en", "a") for k in range(40)]
    docs = make_docs(rows, clashing=True).withColumn("at", F.lit(1)).withColumn("like", F.lit("x"))
    got = mixing.mix_report(docs.repartition(6)).collect()
    assert len(got) == len(rows)
    sizes = {"a": 5400, "b": 800}
    want = brute_targets(sizes)
    taken = sum(r.taken for r in got if r.source_size == 5400)
    assert abs(taken - want["a"]) <= 10 and {r.copies for r in got if r.source_size == 5400} == {int(want["a"] / 5400), int(want["a"] / 5400) + 1}
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_report(docs.repartition(3)).collect()))
    kept = mixing.mixed(docs).collect()
    assert sum(r.taken for r in kept if r.source == "a") == taken and set(docs.columns) <= set(kept[0].asDict())


def test_pivots_keep_words_and_expectations():
    rows = [(k, 0, 1 + k % 5, 0.3) for k in range(40)]
    ups = defaultdict(int)
    for salt in range(400):
        done, held = mixing.pivot(rows, salt)
        words = sum(up * rows[k][2] for k, up in enumerate(done)) + (held[1] * rows[held[0]][2] if held else 0)
        assert words == pytest.approx(sum(s * p for _, _, s, p in rows))
        for k, up in enumerate(done):
            ups[k] += up
        if held:
            ups[held[0]] += held[1]
    assert all(0.2 < n / 400 < 0.4 for n in ups.values())


def test_pipeline_is_its_stages_by_brute_force(spark, tmp_path, make_docs, sample_rows, odd_rows):
    from test_dedup import brute_classes

    bench = [r.asDict() for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    rows = sample_rows + [r for r in odd_rows if r[0] is not None and r[0] != 14] + [(9000, sample_rows[1][1] + " " + bench[0]["text"], "en", "a")]
    rows = [(i + 100_000 if k >= len(sample_rows) else i, *r) for k, (i, *r) in enumerate(rows)]
    folder = str(tmp_path)
    make_docs(rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(b["item_id"], b["text"]) for b in bench], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = make_docs(rows)

    good = {r.doc_id for r in quality.quality_report(docs).where("kept").collect()}
    step = [r for r in rows if r[0] in good]
    step = [r for r, (i, _, c) in zip(step, brute_classes(step)) if i == c]
    items = [decontaminate.normal(b["text"]) for b in bench]
    matcher = decontaminate.Matcher(tuple(enumerate(items)))
    step = [r for r in step if not matcher.search(decontaminate.normal(r[1]))]
    clean = lambda t: secrets.redacted(t, secrets.base_spans(t) + secrets.confirmed_spans(t))
    step = [(i, clean(t), *r) for i, t, *r in step]
    want = {r.doc_id: (r.copies, r.target) for r in mixing.mix_report(make_docs(step)).collect() if r.copies}

    got = corpus_pipeline.run(spark, folder)
    assert {r.doc_id: (r.copies, r.target) for r in got.collect()} == want and len(want) > 50
    assert {r.doc_id: r.text for r in got.collect()} == {i: t for i, t, *_ in step if i in want}
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, folder)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_take_odd_rows(spark, tmp_path, make_docs, odd_rows):
    """Nulls, repeated ids, ties, long texts and clashing columns, through every stage and the whole run."""
    long_rows = [(None, f"no id {k} " + " ".join(f"w{k}x{j}" for j in range(90)), "en", "a") for k in range(3)]
    long_rows += [(70, "same words here " + " ".join(f"v{j}" for j in range(90)), "en", None)] * 3 + [(70, "other words " + " ".join(f"u{j}" for j in range(90)), None, "b")]
    long_rows += [(71, "same words here " + " ".join(f"v{j}" for j in range(90)), "en", "a")]
    docs = make_docs(odd_rows + long_rows, clashing=True)
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    bench = spark.createDataFrame([(None, None), (1, ""), (2, "u3 u4 u5 u6 u7 u8 u9 u10 u11 u12 u13"), (2, "U3 u4 u5 u6 u7 u8 u9 u10 u11 u12 u13!")], "item_id long, text string")
    bench.write.parquet(f"{folder}/benchmark.parquet")
    out = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, folder)
        assert now.columns == docs.columns
        out[name] = [(r.doc_id, (r.text or "")[:10]) for r in now.collect()]
    kept = out["quality rules"]
    assert kept.count((70, "same words")) == 3 and (70, "other word") in kept and (71, "same words") in kept and all(t for _, t in kept)
    near = out["near dedup"]
    assert near.count((70, "same words")) == 1 and near.count((70, "other word")) == 1 and (71, "same words") not in near
    assert sum(i is None for i, _ in near) == sum(i is None for i, _ in kept) >= 3
    assert sorted(out["benchmark decontamination"], key=repr) == sorted((x for x in near if x != (70, "other word")), key=repr)
    assert len(out["secret scan"]) == len(out["benchmark decontamination"])
    got = corpus_pipeline.run(spark, folder)
    assert {(r.doc_id, (r.text or "")[:10]) for r in got.collect()} <= set(out["secret scan"]) and set(docs.columns) <= set(got.columns) | {"copies", "size"}


def test_an_empty_table_goes_through(spark, tmp_path, make_docs):
    folder = str(tmp_path)
    make_docs([]).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []

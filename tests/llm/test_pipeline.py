"""The pipeline's stages on a small corpus: each against what its operator says, and none loses clean documents."""

import random

import corpus_pipeline


def make(spark, folder):
    rng = random.Random(1)
    vocab = [f"{a}{b}" for a in ("ta", "re", "mo", "li", "su") for b in ("nd", "rk", "st", "ll", "ve", "en")]
    sentence = lambda: " ".join(rng.choice(vocab) + str(rng.randrange(50)) for _ in range(rng.randrange(8, 16))) + "."
    clean = ["\n".join(sentence() for _ in range(rng.randrange(6, 12))) for _ in range(120)]
    bench = [" ".join(sentence() for _ in range(4)) for _ in range(5)]
    passage = " ".join(f"shared{i}" for i in range(55))
    rows = list(enumerate(clean))
    rows += [(200 + i, " ".join(rng.choice(["BUY!!", "$$$", "CLICK>>", "FREE!!!"]) for _ in range(60))) for i in range(60)]
    rows += [(300, clean[3]), (301, clean[5].replace(clean[5].split()[4], "zzz", 1)), (302, clean[7] + "\n" + bench[2]), (303, sentence() + "\n" + passage + "\n" + sentence()), (304, passage + "\n" + sentence()), (305, None), (306, "")]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i, _ in rows if i < 300], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return dict(rows), passage


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    rows, passage = make(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/out{k}")
        docs = spark.read.parquet(f"{folder}/out{k}")
        seen.append({r["doc_id"]: r for r in docs.collect()})
        assert docs.columns == columns or k == 4
    quality, lines, near, leaks, mix = seen
    assert set(range(120)) <= set(quality) and not any(200 <= i < 260 for i in quality)
    assert 300 not in lines and sum(passage in (r["text"] or "") for r in lines.values()) == 1
    assert all(lines[i]["text"] == rows[i] for i in range(120))
    assert set(range(120)) <= set(near)
    assert 302 in near and 302 not in leaks and set(range(120)) <= set(leaks)
    assert set(mix) == set(leaks) and all(0 <= r["taken"] <= 3 * r["size"] for r in mix.values())
    again = {r["doc_id"]: r["taken"] for r in corpus_pipeline.run(spark, folder).collect()}
    assert again == {i: r["taken"] for i, r in mix.items()}


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, repeated rows, columns named like what stages add, no labels, no benchmark, no rows."""
    folder = str(tmp_path)
    words = " ".join(f"word{i} again" for i in range(40))
    kind = "doc_id long, text string, lang string, source string, n_chars long, score string, n_hit string, emptied string, component_id string, taken string"
    more = ("a", "b", "c", "d", "e")
    rows = [(1, words, "en", "s", len(words), *more), (1, words, "en", "s", len(words), *more), (2, words + " more", None, None, None, *more), (None, "other text " * 30, "en", "s", 1, *more), (3, None, None, None, None, *[None] * 5), (4, "", "en", None, 0, *more), (5, "x" * 300_000, "en", "s", 5, *more)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(None, None), (1, "!"), (None, "one two")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for name, df in (("full", spark.createDataFrame(rows, kind)), ("none", spark.createDataFrame([], kind))):
        docs = df
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, folder).write.parquet(f"{folder}/{name}{k}")
            before, docs = docs, spark.read.parquet(f"{folder}/{name}{k}")
            assert docs.columns == before.columns or k == 4
            if name == "full" and k == 0:
                assert docs.count() == len(rows)  # without labels every score is 0.5, and nothing is rejected
            if name == "full" and k == 2:
                assert sorted((r["doc_id"] or 0) for r in docs.collect()).count(2) == 0
        assert docs.count() == (6 if name == "full" else 0)

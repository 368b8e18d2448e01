"""The stages in order, against what each must keep."""

import random

import corpus_pipeline
from seriesloom.llm import mixing

from .helpers import docs, prose



def table_folder(spark, tmp_path):
    rng, rows, marks = random.Random(3), [], []
    for i in range(240):
        toxic = int(i % 4 == 0)
        text = prose(rng, rng.randint(20, 80)).split()
        for _ in range(4 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(["vileword", "nastyone"]))
        rows.append((i, " ".join(text), rng.choice("abc")))
        marks.append((i, toxic))
    rows += [(1000 + i, rows[i][1], "b") for i in range(1, 240, 7)]  # copies
    docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), rows


def test_stages(spark, tmp_path):
    folder, rows = table_folder(spark, tmp_path)
    start = spark.read.parquet(f"{folder}/documents.parquet")
    clean = corpus_pipeline.without_toxic(spark, start, folder)
    kept = {r["doc_id"] for r in clean.collect()}
    toxic = {i for i, t, _ in rows if "vileword" in t or "nastyone" in t}
    assert clean.columns == start.columns and not kept & toxic and len(kept) >= 0.97 * (len(rows) - len(toxic))
    single = corpus_pipeline.without_copies(spark, start, folder)
    assert single.columns == start.columns and {r["doc_id"] for r in single.collect()} == set(range(240))
    mixed = corpus_pipeline.mixed(spark, single, folder)
    assert mixed.columns == start.columns
    words = sum(len(r["text"].split()) for r in mixed.select("text").collect())
    want = sum({r["source_size"]: r["target"] for r in mixing.taken(single).collect()}.values())
    assert abs(words - want) < 0.05 * want
    done = corpus_pipeline.encoded(spark, mixed, folder)
    assert done.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and done.count() == mixed.count()


def test_run(spark, tmp_path):
    folder, rows = table_folder(spark, tmp_path)
    got = corpus_pipeline.run(spark, folder).collect()
    names = {r["doc_id"] for r in got}
    assert got and not {i for i in names if i >= 1000} and not {i for i in names if i < 240 and i % 4 == 0}
    assert len({r["ids_sha256"] for r in got}) == len(names)


def test_near_copies_from_four_fifths_go(spark, tmp_path):
    """Near copies that five words and 0.8 link and four words and 0.85 do not, and one that neither links."""
    rng = random.Random(5)

    def sets(w, n):
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    def likeness(a, b, n):
        a, b = sets(a, n), sets(b, n)
        return len(a & b) / len(a | b)

    rows, near = [], []
    for k in range(6):
        base = [f"w{k}x{i}" for i in range(200)]
        swapped, long, run, far = list(base), base + [f"more{k}x{i}" for i in range(45)], list(base), list(base)
        for at in (30, 80, 130, 180):
            swapped[at] += "y"
        run[60:75] = [f"run{k}x{i}" for i in range(15)]
        for at in range(5, 200, 25):
            far[at] += "z"
        copies = [(10 * k + 1, swapped), (10 * k + 2, long), (10 * k + 3, run)]
        assert all(likeness(base, c, 5) >= 0.8 and likeness(base, c, 4) < 0.85 for _, c in copies) and likeness(base, far, 5) < 0.8
        near += [i for i, _ in copies]
        rows += [(10 * k, base), *copies, (10 * k + 4, far)]
    rng.shuffle(rows)
    got = corpus_pipeline.without_copies(spark, docs(spark, [(i, " ".join(w)) for i, w in rows]), str(tmp_path))
    assert {r["doc_id"] for r in got.collect()} == {i for i, _ in rows} - set(near)

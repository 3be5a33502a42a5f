"""Each stage of the pipeline on what its predecessor kept."""

import collections
import random

import pytest

SF = "/root/testdata/sf0.001"


def test_pipeline_runs_and_keeps_the_columns(spark):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.toPandas()
        assert 0 < len(rows) <= kept
        kept, docs = len(rows), spark.createDataFrame(rows, docs.schema)
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).select("doc_id").collect()} == set(rows["doc_id"])


def planted():
    """(doc_id, text) of a small corpus with toxic rows, copies, near copies and passages under unique, shared, repeated and null ids."""
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for i in range(300):
        w = words(60)
        if i % 5 == 0:
            w[7:16:3] = [rng.choice(("nasty", "vile", "horrid", "foul", "rotten", "grim")) for _ in range(3)]
        rows.append((i, " ".join(w)))
    base, passage = words(120), " ".join(words(70))
    near = [" ".join([*base[: 9 * k], f"new{k}", *base[9 * k + 1 :]]) for k in range(5)]
    rows += [(400 + k, t) for k, t in enumerate(near)]
    rows += [(402, "another text under one id " + " ".join(words(40)))]
    rows += [(500, "Same Text " + " ".join(base[:3])), (501, "same text " + " ".join(base[:3])), (501, "same text " + " ".join(base[:3])), (None, "same text " + " ".join(base[:3]))]
    rows += [(None, "only under null " + rows[1][1][:90])] * 2 + [(None, "under null too " + " ".join(words(30)))]
    rows += [(600 + k, " ".join(words(25)) + " " + passage + " " + " ".join(words(25))) for k in range(3)]
    rows += [(700, ""), (701, None), (None, None)]
    rng.shuffle(rows)
    return rows


def grams(text):
    w = (text or "").split()
    return collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def plain_copies(rows):
    best = {}
    for i, t in rows:
        key = (t or "").lower()
        if key not in best or (i is not None and (best[key][0] is None or i > best[key][0])):
            best[key] = (i, t)
    return list(best.values())


def plain_near(rows):
    bags, root = [grams(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = sum((bags[a] & bags[b]).values())
            if both and both >= 0.8 * sum((bags[a] | bags[b]).values()) or (rows[a][1] or "") == (rows[b][1] or ""):
                root = [root[b] if r == root[a] else r for r in root]
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root[k]] = min(least.get(root[k], (True, 1, 0)), (i is None, i or 0, k))
    return [rows[k] for _, _, k in least.values()]


def plain_passages(rows, size=50):
    first = {}
    for i, t in rows:
        w = (t or "").split()
        for k in range(len(w) - size + 1):
            key, at = tuple(w[k : k + size]), (i is None, i or 0)
            first[key] = min(first.get(key, at), at)
    out = []
    for i, t in rows:
        w = (t or "").split()
        gone = {k + j for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] < (i is None, i or 0) for j in range(size)}
        out.append((i, " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t))
    return out


TOXIC = set(range(0, 300, 5))
PLAIN = {"toxicity": lambda r: [x for x in r if x[0] not in TOXIC], "exact_dedup": plain_copies, "near_dedup": plain_near, "substring_dedup": plain_passages}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("planted"))
    table(spark, planted()).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in TOXIC)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_against_plain_python(spark, folder):
    import corpus_pipeline

    want = planted()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        given, want = table(spark, want), PLAIN[name](want)
        got = [tuple(r) for r in stage(spark, given, folder).select("doc_id", "text").collect()]
        assert len(got) < given.count() or name == "substring_dedup"
        assert collections.Counter(got) == collections.Counter(want), name
        if name == "exact_dedup":  # repeated rows count once
            assert stage(spark, given.union(given), folder).count() == len(want)


def test_run_against_plain_python(spark, folder):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    import corpus_pipeline

    want = planted()
    for plain in PLAIN.values():
        before, want = want, plain(want)
        assert collections.Counter(before) != collections.Counter(want)
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    pieces, tokens = collections.Counter(), collections.Counter()
    for r in corpus_pipeline.run(spark, folder).collect():
        pieces[r["doc_id"], r["doc_tokens"]] += r["length"]
    for i, x in want:
        n = len(t.encode(x or "", add_special_tokens=False).ids) + 1
        tokens[i, n] += n
    assert pieces == tokens


def test_near_stage_writes_rows_in_proportion(spark, monkeypatch):
    """The stage's pairs within a group a little below the similarity are no more rows than its texts, and it keeps what plain Python keeps."""
    import corpus_pipeline
    from thermogrid.llm.store import Workspace

    keep, written = Workspace.keep, collections.Counter()

    def counted(self, df, tag):
        out = keep(self, df, tag)
        written[tag.split("-")[0]] += out.count() if tag.startswith("found") else 0
        return out

    monkeypatch.setattr(Workspace, "keep", counted)
    rng, rows = random.Random(31), []
    base = [f"w{rng.randrange(10**6)}" for _ in range(600)]
    for k in range(40):
        t = list(base)
        for c in rng.sample(range(0, 600, 5), 8):
            t[c] = f"new{k}-{c}"
        rows.append((k, " ".join(t)))
    want = plain_near(rows)
    got = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, table(spark, rows), "").select("doc_id", "text").collect()]
    assert sorted(got) == sorted(want) and 20 < len(want) < len(rows)
    assert "found" in written and written["found"] <= len(rows)


CLASHING = "doc_id long, text string, n_chars int, toxic_score string, toxic_predicted string, row_number int, _n int, _id string, grp string, text_sha int, lost_id string, text_changed string, score double, predicted int, class_id long, keep_id long"


def test_stages_with_empty_tables_long_texts_and_clashing_names(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    rng = random.Random(21)
    words = lambda n: " ".join(f"k{rng.randrange(10**6)}" for _ in range(n))
    long, passage = words(400_000), words(60)  # longer than any slice
    texts = [long, long, words(30) + " " + passage, passage + " " + words(30), "", None, words(8), words(50) + " vile nasty"]
    rows = [(k, t, len(t or ""), "a", "b", 1, 2, "c", "d", 3, "e", "f", 0.5, 1, 7, 8) for k, t in enumerate(texts)]
    labels = [(k, int(k == 7)) for k in range(8)] + [(900 + k, k % 2) for k in range(4)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, CLASHING)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.columns == docs.columns and none.count() == 0, name
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = {r["doc_id"]: r for r in out.collect()}
        for k, r in got.items():  # what users' columns hold stays
            assert tuple(r)[3:] == rows[k][3:], (name, k)
        if name in ("exact_dedup", "near_dedup"):
            assert len(got) == 6 and (1 if name == "exact_dedup" else 0) in got and len({4, 5} & set(got)) == 1
        elif name == "substring_dedup":
            assert got[1]["text"] == "" and got[0]["text"] == long and passage not in got[3]["text"] and got[3]["n_chars"] == len(got[3]["text"])
        else:
            assert {0, 1, 2, 3, 4, 5, 6} <= set(got)
    pack = corpus_pipeline.STAGES[-1][1]
    assert pack(spark, docs.limit(0), str(tmp_path)).count() == 0
    pieces = pack(spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == set(range(8)) and sum(r["length"] for r in pieces if r["doc_id"] == 0) == next(r["doc_tokens"] for r in pieces if r["doc_id"] == 0) > 400_000

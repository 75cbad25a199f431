import corpus_pipeline as P
from knotwork.llm import bpe, langid, minhash, mixing, queries
from knotwork.llm.line_dedup import LineDedupParams
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_mixing import plain_mix

DATA = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(((r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()), key=str)


def test_stages_do_what_brute_force_does(spark):
    docs = first = spark.read.parquet(f"{DATA}/documents.parquet")
    after = {}
    for name, stage in P.STAGES[:-1]:
        before = rows_of(docs)
        docs = P.cut(stage(spark, docs, DATA), name)
        assert docs.dtypes == first.dtypes, name
        after[name] = (before, rows_of(docs))
    before, kept = after["language_id"]
    accepted = {r["doc_id"] for r in langid.identify(first).where("accepted").collect()}
    assert kept == [r for r in before if r[0] in accepted] and len(kept) >= 0.98 * len(before)
    before, kept = after["line_dedup"]
    p = LineDedupParams()
    cleaned = brute_lines(before, p.min_sites, p.copied)
    want = [(i, cleaned[i], lang, source) for i, text, lang, source in before if cleaned[i] == text or cleaned[i].strip()]
    assert kept == sorted(want, key=str)
    before, kept = after["near_duplicates"]
    shingles = {}
    for i, text, _, _ in before:
        words = "".join(c if c.isalnum() or not c.isascii() else " " for c in text.lower()).split()
        shingles[i] = {tuple(words[k : k + 3]) for k in range(max(1, len(words) - 2))} if words else set()
    left = {r[0] for r in kept}
    alike = lambda a, b: len(shingles[a] & shingles[b]) / max(1, len(shingles[a] | shingles[b]))
    gone = [i for i, *_ in before if i not in left]
    assert gone and all(any(o != i and alike(i, o) > 0.35 for o in shingles) for i in gone)  # nobody goes without a copy
    close = [(a, b) for a in shingles for b in shingles if a < b and alike(a, b) >= 0.65]
    assert sum(a in left and b in left for a, b in close) <= 0.03 * len(close)
    assert [r for r in before if r[0] in left] == kept
    before, _ = after["mixing"]
    want = sorted(str((source or None, text)) for source, _, text in plain_mix([(i, t, lang, s) for i, t, lang, s in before], mixing.MixParams()).values())
    assert sorted(str((r["source"] or None, r["text"])) for r in docs.collect()) == want
    last = P.STAGES[-1][1](spark, docs, DATA)
    assert last.where("not round_trip").count() == 0
    texts = sorted(r["text"] for r in bpe.decode_tokens(last).collect())
    assert texts == sorted(r["text"] for r in docs.collect())
    assert rows_of(spark.createDataFrame(last.selectExpr("doc_id", "cast(token_ids as string) text", "lang", "source").collect())) == rows_of(
        P.run(spark, DATA).selectExpr("doc_id", "cast(token_ids as string) text", "lang", "source")
    )


def test_stages_take_messy_documents(spark, messy):
    docs, seen = messy, []
    for name, stage in P.STAGES[:-1]:
        docs = P.cut(stage(spark, docs, DATA), name)
        assert docs.dtypes == messy.dtypes
        seen.append(rows_of(docs))
    texts = [[t for _, t, *_ in rows] for rows in seen]
    base = messy.first()["text"]
    assert texts[0].count(base) == 4 and all(t and any(c.isalpha() for c in t) for t in texts[0])
    assert seen[1] == seen[0]  # one source, no boilerplate
    assert texts[2].count(base) == 1 and base + " more" not in texts[2] and [r[0] for r in seen[2] if r[1] == base] == [1]
    assert sum(len(t) > 100000 for t in texts[2]) == 1
    tokens = lambda rows: sum(len(t.split()) for t in rows)
    assert tokens(texts[3]) >= 0.5 * tokens(texts[2]) and len(texts[3]) == len(seen[3])  # a block of each slot
    last = P.STAGES[-1][1](spark, docs, DATA)
    assert last.count() == last.where("round_trip").count() == len(seen[3])


def test_stages_take_an_empty_table(spark, make):
    docs = make([], clash=True)
    for name, stage in P.STAGES[:-1]:
        docs = P.cut(stage(spark, docs, DATA), name)
        assert docs.count() == 0 and docs.dtypes == make([], clash=True).dtypes
    assert P.STAGES[-1][1](spark, docs, DATA).count() == 0


def test_queries_run(spark):
    for name, query in queries.QUERIES.items():
        many = query(spark, DATA).count()
        assert many > 0 or name in ("op3_secrets", "op9_embeddings"), name  # the smallest tables hold none


def test_near_copies_of_the_table_are_one(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(30)
    copies = docs.selectExpr("doc_id + 100000 as doc_id", "concat(text, ' ', 'tail') as text", "lang", "source", "n_chars").where("length(text) > 800")
    kept = minhash.drop_near_duplicates(docs.unionByName(copies))
    assert copies.count() > 5 and kept.where("doc_id >= 100000").count() == 0

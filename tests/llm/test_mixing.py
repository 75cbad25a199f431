import re
from collections import Counter

import numpy as np

from knotwork.llm import mixing as X


def test_permutation_is_one_to_one():
    for n in (1, 2, 3, 10, 1000, 4097):
        out = X.permute(np.arange(n), np.full(n, n), np.full(n, 99))
        assert sorted(out.tolist()) == list(range(n))
    assert X.permute(np.arange(1000), np.full(1000, 1000), np.full(1000, 1)).tolist() != X.permute(np.arange(1000), np.full(1000, 1000), np.full(1000, 2)).tolist()


def test_token_starts():
    import pyarrow as pa

    for text in ("a b", "  a b ", "a", "", " ", "a\n\nb\tc  ", "é ñ"):
        at, raw = X.buffers(pa.array([text, "x y", text]))
        n = np.diff(np.searchsorted(X.token_starts(raw, at), at)).tolist()
        words = max(len(text.split()), 1 if text else 0)
        assert n == [words, 2, words], text


def test_blocks_of_an_epoch_are_the_documents(make, prose):
    docs = [(i, prose(i, 30 + i % 50), "en", f"s{i % 3}") for i in range(200)]
    p = X.MixParams(block_tokens=37, slots_per_shard=16, bucket_tokens=700, weights=(("s1", 2.0), ("absent", 5.0)), epochs=6)
    rows = X.mix(make(docs, clash=True), p).collect()
    assert {r["source"] for r in rows} == {"s1"}
    blocks = {}
    for r in rows:
        assert blocks.setdefault(r["block_index"], r["text"]) == r["text"]
        assert len(re.findall(r"\S+", r["text"])) == r["n_tokens"] <= 37 and r["n_chars"] == len(r["text"])
    assert sorted(blocks) == list(range(len(blocks)))
    whole = "".join(blocks[i] for i in sorted(blocks))
    own = [t for _, t, _, s in docs if s == "s1"]
    assert len(whole) == sum(len(t) + 2 for t in own) and all(whole.count(t + "\n\n") >= 1 for t in own)
    uses = Counter(r["block_index"] for r in rows)
    assert max(uses.values()) - min(uses.values()) <= 1  # each epoch uses each block once
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows)
    shards = Counter(r["shard"] for r in rows)
    assert all(n == 16 for s, n in shards.items() if s != max(shards))


def test_shares_follow_weights(make, prose):
    docs = [(i, prose(i, 50), "en", "big" if i % 10 else "small") for i in range(300)]
    rows = X.mix(make(docs), X.MixParams(block_tokens=10, slots_per_shard=100, weights=(("big", 1.0), ("small", 1.0)))).collect()
    share = Counter(r["source"] for r in rows)["small"] / len(rows)
    assert abs(share - 0.5) < 0.05
    again = X.mix(make(docs), X.MixParams(block_tokens=10, slots_per_shard=100, weights=(("big", 1.0), ("small", 1.0)))).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_messy_rows(messy):
    out = X.mix_documents(messy, X.MixParams(block_tokens=50))
    assert out.dtypes == messy.dtypes and out.count() > 700
    assert {r["source"] for r in out.collect()} <= {"", "src0"}


def test_empty_table(make):
    assert X.mix(make([])).count() == 0 and X.mix(make([(1, None), (2, "")])).count() == 0


def test_draws_are_multinomial():
    weights = np.array([0.5, 0.0, 0.3, 0.2, 0.0])
    upto = np.cumsum(weights)
    upto[3:] = 1
    total = np.zeros(5)
    for shard in range(400):
        source, n = X.draw(shard, 100, upto, 7)
        again, m = X.draw(shard, 100, upto, 7)
        assert n.sum() == 100 and (n > 0).all() and source.tolist() == again.tolist() and n.tolist() == m.tolist()
        total[source] += n
    assert (np.abs(total / total.sum() - weights) < 4 * np.sqrt(weights * (1 - weights) / 40000) + 1e-12).all()
    first, last = X.draw(3, 5, np.array([0.5, 1.0]), 1), X.draw(4, 5, np.array([0.5, 1.0]), 1)
    assert first[0].tolist() != last[0].tolist() or first[1].tolist() != last[1].tolist()


def test_running_sums(spark):
    rng = np.random.default_rng(2)
    n = 10000  # more than two ranges of one key
    rows = [("hot", i, int(x)) for i, x in enumerate(rng.integers(0, 9, n))] + [("cold", i, 1) for i in (0, 5000, 9000)]
    found = X.running(spark.createDataFrame(rows, "k string, o long, v long"), "k", "o", "v", "before").collect()
    want = np.cumsum([0, *(v for k, _, v in rows if k == "hot")])
    got = {(r["k"], r["o"]): r["before"] for r in found}
    assert len(found) == n + 3 and all(got["hot", i] == want[i] for i in range(n)) and [got["cold", i] for i in (0, 5000, 9000)] == [0, 1, 2]


def plain_mix(docs, p):
    """(shard, slot) -> (source, block, text) by loops: documents laid end to end in buckets, cut into blocks, drawn, permuted."""
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = SparkSession.getActiveSession()
    named = spark.createDataFrame([(i, t + "\n\n", s or "") for i, t, _, s in docs if t], "doc_id long, text string, source string")
    fine = 1 << max(6, (len(docs) // 512).bit_length())
    hashed = named.select("*", F.pmod(F.xxhash64(F.lit(p.seed), "doc_id", "text"), F.lit(fine)).alias("fine"), F.xxhash64(F.lit(p.seed + 1), "doc_id", "text").alias("order")).collect()
    sources, blocks = {}, {}
    for r in hashed:
        sources.setdefault(r["source"], []).append(r)
    tokens = {s: sum(max(1, len(r["text"].split())) for r in rows) for s, rows in sources.items()}
    for s, rows in sources.items():
        buckets = min(fine, 1 << (max(0, -(-tokens[s] // p.bucket_tokens) - 1)).bit_length())
        blocks[s] = []
        for bucket in range(buckets):
            own = sorted((r for r in rows if r["fine"] % buckets == bucket), key=lambda r: (r["order"], r["doc_id"], r["text"]))
            words = re.findall(r"\s*\S+\s*", "".join(r["text"] for r in own))
            blocks[s] += ["".join(words[i : i + p.block_tokens]) for i in range(0, len(words), p.block_tokens)]
    names = sorted(sources)
    weights = np.array([float(dict(p.weights)[s]) if p.weights else tokens[s] ** p.alpha for s in names])
    total = round(sum(map(len, blocks.values())) * p.epochs)
    upto = np.cumsum(weights / weights.sum())
    upto[-1] = 1
    used, out = Counter(), {}
    for shard in range(-(-total // p.slots_per_shard)):
        slots = min(p.slots_per_shard, total - shard * p.slots_per_shard)
        drawn = sorted(int(np.searchsorted(upto, x, side="right")) for x in np.random.Generator(np.random.Philox(key=[p.seed, shard])).random(slots))
        for at, k in enumerate(drawn):
            size = len(blocks[names[k]])
            turn, ordinal = divmod(used[k], size)
            used[k] += 1
            key = (p.seed + 1000003 * k + 0x9E3779B97F4A7C15 * turn) % 2**64
            block = int(X.permute(np.array([ordinal]), np.array([size]), np.array([key], np.uint64))[0])
            slot = int(X.permute(np.array([at]), np.array([slots]), np.array([(~p.seed & (1 << 62)) + shard], np.uint64))[0])
            assert (shard, slot) not in out
            out[shard, slot] = (names[k], block, blocks[names[k]][block])
    return out


def test_mix_against_plain_loops(make, prose):
    docs = [(i, "\n ".join([prose(i, 20 + i % 60), prose(i + 1, 5)]), "en", [None, "s1", "s1", "s1", "s2"][i % 5]) for i in range(160)] + [(500, None, "en", "s1"), (501, "", "en", "s1"), (502, prose(3, 3000), "en", "s2")]
    for p in (X.MixParams(block_tokens=31, slots_per_shard=20, bucket_tokens=900, epochs=2.5), X.MixParams(block_tokens=64, slots_per_shard=1000, weights=(("", 1), ("s1", 5), ("s2", 2)))):
        got = {(r["shard"], r["slot"]): (r["source"], r["block_index"], r["text"]) for r in X.mix(make(docs), p).collect()}
        assert got == plain_mix(docs, p)

import random

import duckdb

from knotwork.llm import line_dedup as L


def brute(rows, least, copied=1.0):
    def spread(counted):
        sites = {}
        for _, text, _, source in counted:
            for line in (text or "").split("\n"):
                sites.setdefault(line, set()).update({source} - {None})
        return {x for x, s in sites.items() if x and len(s) >= least}

    wide = spread(rows)
    bad = spread([r for r in rows if r[1] is not None and sum(len(x) for x in set(r[1].split("\n")) & wide) <= copied * len(r[1])])
    keeper = {}
    for i, text, _, _ in rows:
        for line in (text or "").split("\n"):
            keeper[line] = min(keeper.get(line, i), i)
    return {i: None if t is None else "\n".join(x for x in t.split("\n") if x not in bad or keeper[x] == i) for i, t, _, _ in rows}


def test_matches_brute_force(make):
    rows = []
    for i in range(60):
        shared = [f"line on {n} sites" for n in (1, 2, 4, 5, 6, 9, 20, 30) if i % 30 < n]
        rows.append((i, "\n".join([f"own {i}", *shared, "", f"own again {i}"]), "en", f"site{i % 30}"))
    for least, copied in ((2, 1.0), (5, 1.0), (10, 1.0), (2, 0.5), (5, 0.7), (10, 0.5)):
        got = {r["doc_id"]: r["text"] for r in L.drop_boilerplate(make(rows), L.LineDedupParams(min_sites=least, copied=copied)).collect()}
        assert got == brute(rows, least, copied)


def test_copies_are_told_from_boilerplate(make):
    rng = random.Random(6)
    page = [f"the copied page has a paragraph {k} of some length" for k in range(8)]
    rows = []
    for i in range(60):  # near copies on thirty sites: a line of each is its own
        at = rng.randrange(8)
        rows.append((i, "\n".join([*page[:at], f"edited in {i}", *page[at + 1 :], "shared licence line"]), "en", f"s{i % 30}"))
    rows += [(100 + i, f"text of its own that is longer than the rest of page {i}\nshared licence line\n" + ("on nine" if i < 9 else "on more"), "en", f"s{i}") for i in range(20)]
    got = {r["doc_id"]: r["text"] for r in L.drop_boilerplate(make(rows)).collect()}
    assert got == brute(rows, 10, 0.5)
    assert all(got[i] == rows[i][1].removesuffix("\nshared licence line") for i in range(1, 60)) and got[0] == rows[0][1]
    assert got[105].endswith("page 5\non nine") and got[112].endswith("page 12") and got[109].endswith("\non more")


def test_sql_gives_the_same_rows(make, tmp_path):
    rng = random.Random(9)
    rows = [(i, "\n".join(rng.choices([f"line number {k}" for k in range(9)], k=rng.randint(0, 4)) + [f"own text {i} " + "x" * rng.randint(0, 40)]), "en", f"s{rng.randint(0, 14)}") for i in range(300)]
    docs = make(rows)
    docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = sorted(con.sql(L.ORACLE).fetchall())
    assert sorted(map(tuple, L.drop_boilerplate(docs).collect())) == want and sum(r[-1] for r in want) > 50


def test_coarse_sketches_are_settled_exactly(make):
    rows = [(i, f"edge {i % 7}", "en", f"s{i}") for i in range(7 * 40)]
    p = L.LineDedupParams(min_sites=40, copied=1.0, log_registers=4, sigmas=3)
    got = {r["doc_id"]: r["text"] for r in L.drop_boilerplate(make(rows), p).collect()}
    assert got == brute(rows, 40) and sum(t == "" for t in got.values()) == 7 * 39


def test_messy_rows(messy):
    out = L.drop_boilerplate(messy, L.LineDedupParams(min_sites=2, copied=1.0))
    assert out.columns == [*messy.columns, "removed_lines"] and out.count() == messy.count()
    assert out.where("removed_lines > 0").count() == 0  # one source, and nulls are none


def test_repeated_rows_and_null_ids(make):
    rows = [(2, "same\nb"), (2, "same\nb"), (None, "same\nc", "en", "s1"), (3, "same", "en", "s2"), (3, "same", "en", None)]
    got = sorted((r["doc_id"] or 0, r["text"], r["removed_lines"], r["n_chars"]) for r in L.drop_boilerplate(make(rows, clash=True), L.LineDedupParams(min_sites=3, copied=1.0)).collect())
    assert got == [(0, "c", 1, 1), (2, "same\nb", 0, 6), (2, "same\nb", 0, 6), (3, "", 1, 0), (3, "", 1, 0)]


def test_empty_table(make):
    assert L.drop_boilerplate(make([])).count() == 0

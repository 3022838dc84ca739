import random
import re
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from lodeline.llm import cells, components, groups, leaks, mixing, neighbours, pieces, scans, skeleton, varied


# --- 1 scanned pages


def scanned_paper():
    def page(k, what):
        return (f"The {what} substitution was repeated on the layered flux line which gave a transition tempera-\nture close to 7.36 T. Earlier work on the {what} flux-\n"
                f"pinned cuprate assumed a constant {what}.\nThe pre5ent data of the {what} model exclude this above 6B4 T.\n- {k} -\n\nPROCEEDINGS OF APPLIED STATES\n\n")  # fmt: skip

    return "Notes on a layered line with spin\n\n" + "".join(page(k, w) for k, w in zip(range(10, 14), ("isotope", "uniform", "granular", "boundary")))


SOUND = "# A title of this paper\n\nThe transition temperature of the flux-pinned present model was isotope.\nCounts in order:\n57\n324\n"


def test_scans(spark):
    rows = [("a", "Proceedings of Applied States", scanned_paper()), ("a", "Proceedings of Applied States", scanned_paper()), ("s", "J", SOUND), ("n", "J", None), ("e", "J", ""), ("u", None, "one line" * 2000)]
    rows += [(f"s{i}", "J", SOUND * 8) for i in range(12)]
    df = spark.createDataFrame(rows, "paper_id string, journal string, paper_md string").withColumn("line_no", F.lit(1)).withColumn("kind", F.lit("x"))
    damage = scans.damaged_lines(df)
    got = {(r.paper_id, r.line_no, r.kind) for r in damage.collect()}
    lines = scanned_paper().split("\n")
    want = set()
    for i, s in enumerate(lines, 1):
        if s.endswith("tempera-"):
            want.add(("a", i, "hyphen"))
        if "pre5ent" in s:
            want.add(("a", i, "misread"))
        if s.startswith("PROC"):
            want.add(("a", i, "header"))
        if s.startswith("- 1"):
            want.add(("a", i, "page_no"))
    assert got == want
    fixed = {r.paper_id: r.repaired for r in scans.repaired(df, damage).collect()}
    assert fixed["s"] == SOUND and fixed["n"] is None and fixed["e"] == ""
    assert "temperature close" in fixed["a"] and "flux-pinned" in fixed["a"] and "present data" in fixed["a"] and "604 T" not in fixed["a"].replace("684", "x") and "PROCEEDINGS" not in fixed["a"]
    assert scans.damaged_lines(df.limit(0)).count() == 0


def test_frequent_misread_numbers_are_found(spark):
    counts = spark.createDataFrame([("lO0", 20), ("2OO", 9), ("lSB", 30), ("lattice", 50)], "word string, n bigint")
    common = scans._common(counts, spark.createDataFrame([], "word string"))
    assert common == {"lattice"}
    page = scans.Page("heated to lO0 K in the lattice\nand kept at lSB K", "J")
    assert scans.Evidence(page, np.full(2, scans.BODY), common | {"lO0"}).numbers == [0, 1]


def test_page_numbers_far_from_the_margin_and_long_heads():
    title, journal = "A study of " + "very long words " * 9 + "end", "Journal of " + "Applied " * 4 + "States"
    text = title + "\n\n" + "\n".join("a line of text that goes on\n" * 6 + " " * 40 + str(k) + "\n" + title.upper() + " " + journal for k in (208, 209, 210))
    page = scans.Page(text, journal)
    lines = text.split("\n")
    assert [i for i in range(page.n) if page.shape[i] == 2] == [i for i, s in enumerate(lines) if s.strip().isdigit()]
    assert [i for i in range(page.n) if page.head[i] == 2] == [i for i, s in enumerate(lines) if s.startswith("A STUDY")]


def test_codes_hold_no_misread_numbers():
    page = scans.Page("see x.org/1d30348a9f8f41/O1/4f1e686f18ecc4 for it\nat (6B4,7l2,8O3,11O,5S1,99l,O12) and 6B4", "J")
    assert scans.Evidence(page, np.full(2, scans.BODY), frozenset()).numbers == [1] * 8


def test_words_with_several_misreadings_are_tried_against_all_of_a_key(spark):
    # more frequent words share the key of the one that turns into the misread word
    key = scans.misreading_key("plionon")
    assert key == scans.misreading_key("phonon")
    counts = spark.createDataFrame([("phonon", 90), ("plion0n", 2), ("form", 50)] + [(w, 900) for w in ("puonon", "phonan")], "word string, n bigint")
    got = {r.word: r["true"] for r in scans.misread_words(counts, counts, scans.one_misreading(counts)).collect()}
    assert got["plion0n"] == "phonon" and "form" not in got


def test_misreadings():
    for bad, good in (("pre5ent", "present"), ("plionon", "phonon"), ("svmmetry", "symmetry"), ("whi1e", "while"), ("lirnits", "limits"), ("bndge", "bridge"), ("coolmg", "cooling"), ("foUows", "follows"), ("biibbly", "bubbly"), ("bouncl", "bound"), ("efhciency", "efficiency"), ("carmot", "cannot"), ("samphng", "sampling")):
        assert scans.is_misreading(bad, good) and bad in scans.misreadings(good), (bad, good)
    assert not scans.is_misreading("present", "present") and not scans.is_misreading("form", "foam")
    assert scans.misread_number("6B4", " ") and scans.misread_number("l997", " ")
    assert not any(scans.misread_number(t, " ") for t in ("S5l2", "TS232", "lHC78", "123", "N50"))


# --- 2 pieces


@settings(max_examples=60, deadline=None)
@given(hs.text(alphabet=hs.sampled_from("ab .\n。，😀é"), max_size=900), hs.integers(40, 200))
def test_pieces_put_together_again(text, limit):
    overlap = limit // 5
    got = pieces.split(text, limit, overlap)
    assert "".join(text[s if i == 0 else s + overlap : e] for i, (s, e, _) in enumerate(got)) == text
    assert all(e - s <= limit for s, e, _ in got)
    assert all(b[0] == a[1] - overlap for a, b in zip(got, got[1:]))
    # a stretch without white space or one of the marks above the limit, and nothing else, makes a cut of kind 2
    longest = max(map(len, re.split(r"[\s。！？；，]", text)))
    assert (longest > limit) == any(f == 2 for *_, f in got)


def test_edits_stay_near():
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) + ("." if rng.random() < 0.1 else "") for _ in range(9000))
    bodies = lambda t: {t[s:e] for s, e, _ in pieces.split(t, 2000, 100)}
    before, after = bodies(text), bodies(text[:20_000] + " changed here " + text[20_000:])
    assert len(before - after) <= 4


def test_oversized(spark):
    rows = [("a", "x" * 101), ("b", "x" * 100), ("c", "word " * 40), ("c", "word " * 40), (None, "x" * 300), ("d", None), ("e", ""), ("f", " " * 500)]
    df = spark.createDataFrame(rows, "k string, t string").withColumn("piece", F.lit(1))
    assert {(r.item_id, r.cut) for r in pieces.oversized(df, "k", "t", 100, 10).collect()} == {("a", "forced"), ("c", "natural"), ("f", "natural")}
    assert pieces.pieces(df, "k", "t", 100, 10).where("length(piece) > 100").count() == 0
    assert pieces.pieces(df.limit(0), "k", "t", 100, 10).count() == 0
    with pytest.raises(ValueError):
        pieces.pieces(df, "k", "t", 100, 60)


# --- 3, 5, 6 vectors


def crowd(seed=0, noise=60, sizes=(40, 30, 6, 2), spread=0.22):
    rng = np.random.default_rng(seed)
    out = []
    for g, n in enumerate(sizes):
        c = rng.normal(size=64)
        c /= np.linalg.norm(c)
        for i in range(n):
            out.append((f"g{g}_{i:03d}", "d" if g % 2 else "", c + spread * rng.normal(size=64) / 8))
    out += [(f"z{i:03d}", "d", rng.normal(size=64)) for i in range(noise)]
    rng.shuffle(out)
    return [(k, d, i % 5 - 1, (v * rng.uniform(0.5, 2)).astype(np.float32).tolist()) for i, (k, d, v) in enumerate(out)]


def vector_frame(spark, rows):
    bad = [("bad0", "d", 1, [0.0] * 64), ("bad1", "d", 1, [1.0]), ("bad2", "d", 1, None), (None, "d", 1, [1.0] * 64), ("bad3", "d", 1, [float("nan")] * 64)]
    return spark.createDataFrame(rows + bad + rows[:7], "chain_id string, domain string, cluster_id int, vector array<float>").withColumn("id", F.lit("clash")).withColumn("cell", F.lit(0))


def unit_rows(rows):
    rows = sorted({r[0]: r for r in rows}.values())
    v = np.array([r[3] for r in rows], np.float64)
    return [r[0] for r in rows], v / np.linalg.norm(v, axis=1)[:, None]


def true_components(ids, s, least):
    label = list(range(len(ids)))
    for i, j in zip(*np.nonzero(s >= least)):
        a, b = label[i], label[j]
        if a != b:
            label = [min(a, b) if x in (a, b) else x for x in label]
    return {(ids[label[i]], ids[i]) for i in range(len(ids)) if label[i] != i}


@pytest.mark.parametrize("cell_rows", [2000, 12])
def test_groups(spark, cell_rows):
    rows = crowd()
    df = vector_frame(spark, rows)
    found = groups.similarity_groups(df, cell_rows=cell_rows)
    ids, u = unit_rows(rows)
    assert {(r.first_chain_id, r.chain_id) for r in groups.group_members(found).collect()} == true_components(ids, u @ u.T, 0.78)
    profile = {r.first_chain_id: r for r in groups.group_profiles(found).collect()}
    assert sorted(r.size for r in profile.values()) == [2, 6, 30, 40] and all(1 <= len(r.typical) <= 3 for r in profile.values())
    assert groups.similarity_groups(df.limit(0)).count() == 0


def test_chained_links_and_copies(spark):
    angle = np.linspace(0, 3, 12)
    chain = [(f"k{i:02d}", "d", 0, [float(np.cos(a)), float(np.sin(a))] + [0.0] * 62) for i, a in enumerate(angle)]
    copies = [(f"m{i:02d}", "d", 0, [0.0] * 62 + [1.0, 1.0]) for i in range(30)]
    df = vector_frame(spark, chain + copies)
    got = {(r.first_chain_id, r.chain_id) for r in groups.group_members(groups.similarity_groups(df, cell_rows=5)).collect()}
    assert got == {("k00", f"k{i:02d}") for i in range(1, 12)} | {("m00", f"m{i:02d}") for i in range(1, 30)}
    near = neighbours.nearest_neighbours(df, cell_rows=5).collect()
    assert len({r.id for r in near}) == 42 and all(r.rank <= 5 for r in near)
    assert [r.neighbour for r in sorted(near, key=lambda r: r["rank"]) if r.id == "m07"] == ["m00", "m01", "m02", "m03", "m04"]


@pytest.mark.parametrize("cell_rows", [2000, 25])
def test_neighbours(spark, cell_rows):
    rows = crowd(3)
    got = {}
    for r in neighbours.nearest_neighbours(vector_frame(spark, rows), cell_rows=cell_rows).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    ids, u = unit_rows(rows)
    want = {}
    for a, b, _ in neighbours.exact_neighbours(u, np.arange(len(ids)), 5, 0.8):
        want.setdefault(ids[a], set()).add(ids[b])
    total = sum(map(len, want.values()))
    assert sum(len(s & got.get(k, set())) for k, s in want.items()) >= 0.97 * total
    assert neighbours.nearest_neighbours(vector_frame(spark, rows).limit(0)).count() == 0


def test_every_row_has_neighbours(spark):
    rows = crowd(4)
    found = neighbours.nearest_neighbours(vector_frame(spark, rows), cell_rows=25).collect()
    ids, u = unit_rows(rows)
    want = {(ids[a], ids[b]) for a, b, _ in neighbours.exact_neighbours(u, np.arange(len(ids)), 5)}
    assert len(want) == 5 * len(ids) == len(found)
    assert len({(r.id, r.neighbour) for r in found} & want) >= 0.99 * len(want)
    assert min(r.cosine for r in neighbours.nearest_neighbours(vector_frame(spark, rows), cell_rows=25, least=0.8).collect()) >= 0.8


def test_codes_come_near():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 64)).astype(np.float32)
    books = neighbours.Codebooks.fit(x)
    rest = x - books.decode(books.encode(x))
    assert (rest**2).sum() < 0.2 * (x**2).sum()
    assert (((x - books.decode(books.encode(x, beam=6))) ** 2).sum()) <= (rest**2).sum() * 1.01


def test_varied(spark):
    rows = crowd(5, spread=0.1, sizes=(50, 25, 6, 2))
    df = vector_frame(spark, rows)
    ids, u = unit_rows(rows)
    near = (u @ u.T >= 0.95).sum(1) - 1
    feats = varied.features(df, cell_rows=30)
    assert {r.id for r in feats.where("near >= 20").collect()} == {i for i, n in zip(ids, near) if n >= 20}
    assert {r.id: r.near for r in varied.features(df, cell_rows=12, ask=None).collect()} == dict(zip(ids, near.tolist()))
    sizes = spark.createDataFrame([("d", 20), ("", 10_000), ("none", 5)], "domain string, size bigint")
    picked = varied.select_varied(feats, sizes).collect()
    dom = {r[0]: r[1] for r in rows}
    assert len({r.chain_id for r in picked}) == len(picked) and sum(r.domain == "d" for r in picked) == 20
    assert {r.chain_id for r in picked if r.domain == ""} == {k for k, d in dom.items() if d == ""}
    share = sum(r.chain_id.startswith("g1") for r in picked if r.domain == "d") / 20
    assert share < 25 / sum(d == "d" for d in dom.values())
    assert varied.select_varied(varied.features(df.limit(0)), sizes).count() == 0


def test_covered_rows(spark):
    rows = crowd(5, spread=0.1, sizes=(50, 25, 6, 2))
    stats = spark.createDataFrame([("d", 1, 12), ("d", 2, 8), ("", 3, None)], "domain string, cluster_id int, selected_count int")
    told = varied.covered(vector_frame(spark, rows), stats, cell_rows=30).collect()
    ids, u = unit_rows(rows)
    near = dict(zip(ids, ((u @ u.T >= 0.95).sum(1) - 1).tolist()))
    assert {r.chain_id: r.near for r in told} == near and sum(r.chosen for r in told) == 20 and all((r.gain is not None) == r.chosen for r in told)


@pytest.mark.parametrize("bins", [1, 4, 4096])
def test_a_last_round_is_cut_in_bins(spark, bins, monkeypatch):
    monkeypatch.setattr(varied, "HASH_BINS", bins)
    rows = spark.createDataFrame([("d", f"k{i % 40:03d}", i // 40, [0.5, 0.3, 0.2][i % 3], 70) for i in range(200)] + [("e", "x", 0, 0.1, 3)], "domain string, first string, place int, gain double, room long")
    got = varied._first_of(rows).collect()
    assert sum(r.domain == "d" for r in got) == 70 and sum(r.domain == "e" for r in got) == 1
    assert [sum(r.gain == g for r in got) for g in (0.5, 0.3, 0.2)] == [67, 3, 0]


def hot_copies(seed=7, n=90):
    """A third of all rows hold one vector."""
    rng = np.random.default_rng(seed)
    rows = [(k, d, h, v) for k, d, h, v in crowd(seed, sizes=(40, 30), noise=80)]
    v = rng.normal(size=64).astype(np.float32)
    rows += [(f"h{i:03d}", "d", i % 3, v.tolist()) for i in range(n)]
    return rows + [(f"hn{i}", "d", 1, (v + 0.05 * rng.normal(size=64)).astype(np.float32).tolist()) for i in range(4)]


def test_a_third_of_all_rows_are_copies(spark):
    rows = hot_copies()
    df = vector_frame(spark, rows)
    ids, u = unit_rows(rows)
    s = u @ u.T
    apart = cells.set_apart(cells.vectors(df, "chain_id", "vector", "domain"), len(rows), 20, 6)
    assert apart.rows.where("n = 90").count() == 1 and apart.members.count() == 90 and sorted(r.id for r in apart.firsts.collect()) == [f"h{i:03d}" for i in range(6)]
    near = {r.id: r.near for r in varied.features(df, cell_rows=40, hot=20).collect()}
    assert near == dict(zip(ids, ((s >= 0.95).sum(1) - 1).tolist()))
    found = groups.similarity_groups(df, cell_rows=40, hot=20)
    assert {(r.first_chain_id, r.chain_id) for r in groups.group_members(found).collect()} == true_components(ids, s, 0.78)
    got = {}
    for r in neighbours.nearest_neighbours(df, cell_rows=40, hot=20, least=0.8).collect():
        got.setdefault(r.id, []).append((r["rank"], r.neighbour))
    assert [x for _, x in sorted(got["h050"])] == ["h000", "h001", "h002", "h003", "h004"] and [x for _, x in sorted(got["h002"])] == ["h000", "h001", "h003", "h004", "h005"]
    assert all(len(got[f"hn{i}"]) == 5 and all(x.startswith("h") for _, x in got[f"hn{i}"]) for i in range(4))


def test_the_exact_way_finds_everything(spark):
    rows = crowd(9)
    df = vector_frame(spark, rows)
    ids, u = unit_rows(rows)
    found = {(r.id, r.neighbour) for r in neighbours.nearest_neighbours(df, cell_rows=12, ask=None).collect()}
    assert found == {(ids[a], ids[b]) for a, b, _ in neighbours.exact_neighbours(u, np.arange(len(ids)), 5)}
    members = groups.group_members(groups.similarity_groups(df, cell_rows=12, ask=None)).collect()
    assert {(r.first_chain_id, r.chain_id) for r in members} == true_components(ids, u @ u.T, 0.78)


def test_best_exact_in_strips():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 64)).astype(np.float32)
    v[50:80] = v[3]
    v /= np.linalg.norm(v, axis=1)[:, None]
    s = np.round(v.astype(np.float64) @ v.T.astype(np.float64), 7)
    s[np.arange(300), np.arange(300)] = -2
    want = {(i, int(j)) for i, row in enumerate(np.argsort(-s, axis=1, kind="stable")[:, :5]) for j in row}
    for wide in (40, 128, 8192):
        a, b, _ = neighbours.best_exact(v, v, 5, np.arange(300), wide=wide)
        assert set(zip(a.tolist(), b.tolist())) == want


def test_fitting_stays_small():
    """Neither a sample x components matrix nor all scores of a batch are held at once."""
    import tracemalloc

    rng = np.random.default_rng(0)
    v = rng.normal(size=(60_000, 64)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1)[:, None]
    tracemalloc.start()
    index = cells.fit_cells(v, 15_000_000)
    assert 5000 <= len(index.centroids) <= 9000
    index.route(v[:3000], np.arange(3000), 0.17, 8)
    groups.fit_mixture(v[:20_000], start=1024, rounds=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 350e6, peak


def test_thresholds_follow_greedy():
    rng = np.random.default_rng(2)
    n = 40
    ids, w, crowd_, hint = [f"i{i:02d}" for i in range(n)], rng.uniform(0.2, 1, n), [f"c{i % 6}" for i in range(n)], np.full(n, -1)
    rounds, gains = varied.thresholds(ids, w, crowd_, hint)
    first = [i for _, i in sorted((r, i) for i, r in enumerate(rounds.tolist()))][:6]
    assert len({crowd_[i] for i in first}) >= 5 and gains.max() <= 2.0
    assert varied.thresholds([], np.array([]), [], np.array([]))[0].size == 0


def test_a_crowd_is_one_feature_at_any_size(spark):
    n = 20_000
    rows = [("d", 0, "c", 1, 0.9, f"c{i:05d}", n - 1) for i in range(n)] + [("d", 0, f"z{i:03d}", 1, 0.5, f"z{i:03d}", 0) for i in range(300)]
    feats = spark.createDataFrame(rows, "domain string, prototype int, crowd string, hint int, weight float, id string, near bigint")
    picked = varied.select_varied(feats, spark.createDataFrame([("d", 250)], "domain string, size bigint")).collect()
    crowd_ = sorted(r.chain_id for r in picked if r.chain_id.startswith("c"))
    assert len(picked) == 250 and crowd_ == [f"c{i:05d}" for i in range(len(crowd_))] and 1 <= len(crowd_) <= 2


def test_a_crowd_has_one_name_in_all_blocks(spark):
    rng = np.random.default_rng(1)
    c = rng.normal(size=64)
    rows = [(f"k{i:03d}", "d", 0, (c + 0.02 * rng.normal(size=64)).tolist()) for i in range(300)]
    feats = varied.features(spark.createDataFrame(rows, "chain_id string, domain string, cluster_id int, vector array<float>"), cell_rows=20)
    named = varied.one_name(feats).collect()
    assert len(named) == 300 and {r.crowd for r in named} == {"k000"} and len({r.prototype for r in named}) == 1


def test_components(spark):
    edges = [(f"{i:03d}", f"{i + 1:03d}") for i in range(60)] + [("a", "b"), ("b", "c"), ("c", "a"), ("x", "x"), (None, "y")]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[f"{i:03d}"] for i in range(61)} == {"000"} and got["a"] == got["b"] == got["c"] == "a" and "x" not in got


def test_blocks_of_a_hot_cell():
    rng = np.random.default_rng(0)
    v = np.repeat(rng.normal(size=(1, 64)), 400, 0).astype(np.float32)
    v = np.concatenate([v, rng.normal(size=(200, 64)).astype(np.float32)])
    v /= np.linalg.norm(v, axis=1)[:, None]
    index = cells.fit_cells(v, 6000, 500, block_rows=1000)
    assert index.blocks.max() > 1
    rows, cell, block, own = index.route(v, np.arange(len(v)), 0.2, 4)
    assert own.sum() == len(v) and len(set(zip(rows, cell, block))) == len(rows)
    home = {r: (c, b) for r, c, b, o in zip(rows, cell, block, own) if o}
    visits = {}
    for r, c, b in zip(rows, cell, block):
        visits.setdefault(r, set()).add((c, b))
    assert all(home[j] in visits[i] for i in range(0, 400, 37) for j in range(0, 400, 41))


# --- 7 leaks


def brute_leaks(docs, items, least):
    """(words, document word, item word) of each document and item: the longest match, the first of equals."""
    out = {}
    for d, t in docs:
        w = leaks.words(t or "")
        for i, x in items:
            q = leaks.words(x or "")
            best = (0, 0, 0)
            for a in range(len(q)):
                for b in range(len(w)):
                    n = 0
                    while a + n < len(q) and b + n < len(w) and q[a + n] == w[b + n]:
                        n += 1
                    best = max(best, (n, -b, -a))
            if best[0] >= least:
                out[d, i] = (best[0], -best[1], -best[2])
    return out


@pytest.mark.parametrize("seed", range(12))
def test_shards_against_brute_force(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range((1, 2, 5, 12)[seed % 4])]  # one word: every phrase repeats itself
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.randint(0, 25))) for i in range(8)]
    docs = [(i, say(rng.randint(0, 15)) + rng.choice([" other ", " "]) + items[i % 8][1] + " " + say(10)) for i in range(20)] + [(99, ""), (98, None)]
    got = leaks.match_shard(leaks.Probe(items, 4), [d for d, _ in docs], [t for _, t in docs])
    assert {(d, i): x for d, i, *x in map(tuple, got)} == {k: list(x) for k, x in brute_leaks(docs, items, 4).items()}


def test_suffixes_in_order():
    rng = np.random.default_rng(0)
    for n, k in ((1, 1), (50, 2), (300, 1), (400, 30)):
        seq = rng.integers(0, k, n)
        order = leaks.suffix_array(seq, n)
        assert order.tolist() == sorted(range(n), key=lambda i: seq[i:].tolist())


def test_words_without_markup():
    assert leaks.words('<a href="%s">W</a> x<br/>y &amp; **z**' % ("q" * 500)) == ["w", "xy", "z"]
    assert leaks.words("a < b and c > d") == ["a", "b", "and", "c", "d"]


def test_leaks(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(12)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.randint(3, 30))) for i in range(12)] + [(99, None), (98, "")]
    docs = [(i, say(20) + " other " + (items[i % 12][1] or "") + " end " + say(15)) for i in range(40)] + [(100, None), (101, ""), (102, "**W0** w1")]
    docs.append((103, "ｗ０ " + items[3][1].replace(" ", "​ ,  ").upper().replace("W", "Ｗ", 2)))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("words", F.lit(0))
    found = leaks.leaks(df, spark.createDataFrame(items, "item_id long, text string"), least=4, shard_docs=7)
    got = {(r.doc_id, r.item_id): (r["words"], r.doc_word, r.item_word) for r in found.collect()}
    assert got == brute_leaks(docs, items, 4)
    left = {r.doc_id for r in leaks.without_leaks(df, found).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in got}
    assert leaks.leaks(df.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert leaks.leaks(df, spark.createDataFrame([], "item_id long, text string")).count() == 0


# --- 8 mixing


def test_counts_equal_the_tokenizer():
    count = mixing.counter(f"{mixing.TOKENIZER_DIR}/{mixing.RANKS}")
    for t in ("", " ", "a  b", "Hello world, it's 12 o'clock\n\n  next", "ü 中文 text x", "a \nb", " lead", "tail "):
        assert count(t) == len(count.encode(t)), t


@settings(max_examples=100, deadline=None)
@given(hs.text(alphabet=hs.sampled_from("ab1' .\n\t中 "), max_size=60))
def test_counts_of_any_text(t):
    count = mixing.counter(f"{mixing.TOKENIZER_DIR}/{mixing.RANKS}")
    assert count(t) == len(count.encode(t))


def test_mix(spark):
    rows = [(i, "alpha beta gamma " * 20, "A" if i % 3 else " a-") for i in range(60)] + [(100 + i, "delta " * 30, "b_x") for i in range(10)] + [(200, None, "A"), (201, "text", None), (202, "text", "zz"), (203, "", "B X"), (0, "alpha beta gamma " * 20, " a-")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("tokens", F.lit(9)).withColumn("slot", F.lit(1))
    targets = spark.createDataFrame([("A", 0.6, 1), ("B-X", 0.3, 2), ("C", 0.1, 3), ("D", None, None)], "source string, target_share double, max_repeats int")
    sized = mixing.sized_documents(docs, targets)
    plan = mixing.source_plan(sized, targets)
    tokens = {r.source: r.tokens for r in plan.collect()}
    total = sum(tokens.values())
    assert tokens["C"] == 0
    mix = mixing.mixed(sized, plan, block_tokens=100, bucket_docs=7).orderBy("slot", "start").collect()
    uses = {}
    for r in mix:
        uses[r.doc_id] = uses.get(r.doc_id, 0) + 1
    assert max(n for d, n in uses.items() if d < 100) == 1 and {n for d, n in uses.items() if 100 <= d < 200} == {2}
    assert abs(sum(r.tokens for r in mix if r.source == "A") - 0.6 * total) <= 100
    shares = {r.source: r for r in mixing.reached_shares(plan, mixing.mixed(sized, plan)).collect()}
    assert abs(sum(r.actual_share for r in shares.values()) - 1) < 1e-9 and shares["C"].actual_share == 0
    assert {s: r.short for s, r in shares.items()} == {"A": False, "B-X": True, "C": True, "D": False}
    empty = mixing.source_plan(sized.limit(0), targets)
    assert mixing.mixed(sized.limit(0), empty).count() == 0 and mixing.reached_shares(empty, mixing.mixed(sized.limit(0), empty)).where("short").count() == 0


def fluid_deviation(weights, blocks):
    """The most blocks by which any source is off the fluid mix, over all slots."""
    slot_of = mixing.pfair(weights, blocks)
    n = int(blocks.sum())
    assert sorted(np.concatenate(slot_of)) == list(range(n))
    levels = np.unique(np.concatenate([[0], blocks / weights]))
    at = np.array([np.minimum(x * weights, blocks).sum() for x in levels])
    worst = 0
    for w, k, mine in zip(weights, blocks, slot_of):
        fluid = np.minimum(np.interp(np.arange(n + 1), at, levels) * w, k)
        given = np.concatenate([[0], np.cumsum(np.bincount(mine, minlength=n))])
        worst = max(worst, np.abs(given - fluid).max())
    return worst


@settings(max_examples=150, deadline=None)
@given(hs.lists(hs.tuples(hs.floats(0.001, 1), hs.floats(0.05, 1)), min_size=1, max_size=12), hs.integers(1, 400))
def test_schedule_keeps_all_sources_within_a_block(sources, size):
    weights = np.array([w for w, _ in sources]) / sum(w for w, _ in sources)
    blocks = np.maximum(1, np.ceil(weights * size * np.array([e for _, e in sources]))).astype(int)  # some sources end early
    assert fluid_deviation(weights, blocks) < 1


def test_nine_sources_stay_within_a_block():
    weights = np.array([0.3, 0.2, 0.15, 0.1, 0.08, 0.07, 0.05, 0.03, 0.02])
    assert fluid_deviation(weights, np.round(weights * 2000).astype(int)) < 1
    released = mixing.windows(weights, np.round(weights * 2000).astype(int))
    slot_of = mixing.pfair(weights, np.round(weights * 2000).astype(int))
    assert all((r <= s).all() and (s < d).all() for (r, d), s in zip(released, slot_of))


def test_schedule_of_documents(spark):
    sized = spark.createDataFrame([(i, "A" if i % 2 else "B", 100) for i in range(400)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("A", 0.5, 1), ("B", 0.5, 1)], "source string, target_share double, max_repeats int")
    got = mixing.mixed(sized, mixing.source_plan(sized, targets), block_tokens=100).orderBy("slot", "start").collect()
    a = 0
    for n, r in enumerate(got, 1):
        a += r.source == "A"
        assert abs(a - n / 2) <= 1
    coarse = mixing.mixed(sized, mixing.source_plan(sized, targets), block_tokens=100, slots=10).agg(F.max("slot"), F.count("*")).first()
    assert coarse[0] == 9 and coarse[1] == 400


# --- 9 skeletons


def test_skeletons():
    same = [("ﾃｽﾄ", "テスト"), ("ｶﾞ", "ガ"), ("￥", "¥"), ("ℝ", "R"), ("𝐚𝟎", "a0"), ("Ⅹⅼ", "Xl"), ("㎏", "kg"), ("㎡", "m²"), ("it’s 1–2", "it's 1-2"), ("ρɑᴄ", "pac"), ("ꓮꓐ", "AB"), ("ᎪᏟ", "AC"), ("Кк", "Kк"), ("1⁄2", "1/2")]
    same += [("ｆｕｌｌ　ｗｉｄｔｈ", "full width"), ("café", "café"), ("oﬃce", "office"), ("а​b­c", "abc"), ("Кеlvin", "Kelvin"), ("5 K", "5 K"), ("x  y", "x y"), ("µm", "μm"), ("Ω", "Ω"), ("a\r\nb", "a\nb"), ("й", "й")]
    for a, b in same:
        assert skeleton.skeleton(a) == skeleton.skeleton(b), (a, b)
    differ = [("①", "1"), ("½", "1/2"), ("0", "O"), ("I", "l"), ("a", "A"), ("10³", "103"), ("x₂", "x2"), ("a\nb", "a b"), ("a\n\nb", "a\nb"), ("e", "é"), ("ab", "a b")]
    for a, b in differ:
        assert skeleton.skeleton(a) != skeleton.skeleton(b), (a, b)


def test_table_has_all_forms_of_one_look():
    for code in range(0x110000):
        kind, *codes = unicodedata.decomposition(chr(code)).split() or [""]
        if kind in skeleton.SAME_LOOK and codes[0] != "0020" or unicodedata.category(chr(code)) == "Zs" and chr(code) != " ":
            assert code in skeleton.PROTOTYPES, hex(code)
    assert all(skeleton.skeleton(x) == x for x in map(skeleton.skeleton, map(chr, skeleton.PROTOTYPES)))


@settings(max_examples=200, deadline=None)
@given(hs.text(max_size=80))
def test_skeleton_is_settled(t):
    s = skeleton.skeleton(t)
    assert skeleton.skeleton(s) == s and unicodedata.is_normalized("NFD", s)


def test_pairs_of_looks(spark):
    rows = [(1, "abc"), (2, "аbc"), (3, "abc"), (3, "abc"), (4, "ABC"), (5, None), (6, ""), (7, "​"), (8, "ａbc"), (None, "abc"), (9, "x" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("look", F.lit(1)).withColumn("id", F.lit(1))
    got = {(r.doc_id_a, r.doc_id_b) for r in skeleton.look_alike_pairs(df).collect()}
    assert got == {(1, 2), (2, 3), (1, 8), (3, 8), (2, 8), (6, 7)}
    rows = skeleton.look_classes(df).collect()
    assert {r.doc_id: r.links for r in rows} == {i: sum(i in p for p in got) for i in (1, 2, 3, 4, 6, 7, 8, 9)} and sum(r.links for r in rows) == 2 * len(got)
    classes = {r.doc_id: r.class_id for r in rows}
    assert {r.doc_id: r.form_id for r in rows}[3] == 1
    assert classes[8] == 1 and classes[3] == 1 and classes[7] == 6 and 5 not in classes
    assert skeleton.look_alike_pairs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        skeleton.with_skeleton(df, "text", "look")

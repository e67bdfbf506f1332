"""Chosen-path join, Merkle manifest and fill-in-middle against brute force, round trips and their SQL."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from compare import difference, oracle_connection

from polarframe.llm import chosen, fim, merkle

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
WORD = re.compile("[^\\x20\\x09-\\x0D]+")
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"), (6, "one two three\n"), (7, "é" * 3000 + " ß\r\n\n\nx"), (8, "a b\x1cc  d\u0085e"),
    (9, "word \n" * 9000), (10, "same text here and there"), (11, "same text here and there"), (11, "same text here and there"), (None, "no id but words\nin a row"),
    (None, None), (12, "holds <P> itself\nand more\n"), (-13, "ends < \n<S\n>M> 👍\nlast"),
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_chosen_path", "op12_path_copying", "op13_block_rotation"])
def test_equals_sql(spark, name):
    want = oracle_connection(SF).execute(oracle_sql()[name]).df().astype(object).where(lambda d: d.notna(), None)
    assert difference(queries()[name](spark, SF).toPandas(), want) is None


# Chosen paths ----------------------------------------------------------------------------------------------------------


def shingle_sets(rows, width):
    fold = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = [WORD.findall(fold(t)) for _, t in rows]
    return [{tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set() for w in words]


def brute_classes(rows, width, percent):
    sets, up = shingle_sets(rows, width), list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[find(i)].append(d)
    least = lambda i: min((d for d in ids[find(i)] if d is not None), default=None)
    return sorted(((d, len(s), least(i) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def near_copies(seed):
    """Texts of a few groups: exact copies, near ones around the threshold, and unlike ones that share long passages."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    common = [word() for _ in range(80)]
    out = list(ODD)
    for g in range(6):
        base = [word() for _ in range(rng.choice([4, 6, 30, 120, 300]))]
        for _ in range(12):
            text = base[:]
            for _ in range(rng.randrange(4)):
                text[rng.randrange(len(text))] = word()
            out.append((rng.randrange(10_000), " ".join(text)))
    for _ in range(40):
        out.append((rng.randrange(10_000), " ".join([*common, *[word() for _ in range(30)]])))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("width,percent,forced", [(5, 85, False), (5, 85, True), (3, 90, True), (5, 80, False)])
def test_chosen_path_brute_force(spark, width, percent, forced, monkeypatch):
    """``forced``: every node branches as deep as it may, and is compared in many small tiles."""
    if forced:
        for name, value in (("WORK", 0), ("DENSE", 2.0), ("DEPTH", 3), ("BLOCK", 3), ("TILE", 5), ("TILE_GRAMS", 200)):
            monkeypatch.setattr(chosen, name, value)
    rows = near_copies(percent)
    got = chosen.classes(spark.createDataFrame(rows, DOCS).repartition(5), width, percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_classes(rows, width, percent)


def test_chosen_path_recall_at_the_threshold(spark):
    """Pairs right at 85 percent, by words added or replaced: all 1,500 are found (a miss has a chance of one in a million each)."""
    rows = []
    for i in range(1500):
        new = [f"q{i}x{j}" for j in range(9)]
        base = [f"p{i}x{j}" for j in range(54 + i % 2)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base + new if i % 2 else base[:-4] + new[:4]))]
    got = chosen.classes(spark.createDataFrame(rows, DOCS), 5, 85).where("doc_id % 2 = 1")
    linked = {r.doc_id for r in got.where("component_id < doc_id").collect()}
    for x, y in (shingle_sets(rows[:2], 5), shingle_sets(rows[2:4], 5)):
        assert 0.85 <= len(x & y) / len(x | y) < 0.855
    assert len(linked) == 1500


def test_chosen_path_without_links(spark):
    empty = chosen.classes(spark.createDataFrame([], DOCS))
    assert empty.count() == 0
    alone = chosen.classes(spark.createDataFrame([(3, "a text"), (5, "another one"), (7, None)], DOCS))
    assert sorted(tuple(r) for r in alone.collect()) == [(3, 1, 3), (5, 1, 5), (7, 0, 7)]


def test_trees_reach_the_recall():
    assert chosen.tree_miss(85, chosen.trees_for(85, 0.99999)) <= 1e-5 < chosen.tree_miss(85, chosen.trees_for(85, 0.99999) - 1)
    assert chosen._tail(chosen.POOL, 0.85)[chosen.least_agreement(85)] <= chosen.SKETCH_MISS


# Merkle manifest -------------------------------------------------------------------------------------------------------

FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


def leaf_of(values):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha("".join(part(v) for v in values))


def levels_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def brute_manifest(rows):
    sources = defaultdict(list)
    for r in rows:
        cut = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
        changed = leaf_of((*r[:4], r[4].replace("\n", ""))) if cut else leaf_of(r)
        sources[r[1]].append((r[0], leaf_of(r), changed))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(sources[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1])) for s in names}
    low = {s: levels_of([x[1] for x in trees[s]]) for s in names}
    high = levels_of([low[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (doc_id, leaf, changed) in enumerate(trees[s]):
            proof, node = "", changed
            for levels, at in ((low[s], i), (high, k)):
                for level in levels[:-1]:
                    run = at - at % 3
                    left, right = "".join(level[run:at]), "".join(level[at + 1 : run + 3])
                    proof, node, at = proof + left + right, sha(left + node + right), at // 3
            out.append((doc_id, leaf, low[s][-1][0], high[-1][0], proof, node))
    return sorted(out, key=str)


def manifest_rows():
    rng = random.Random(2)
    rows = [(None, None, None, None, None), (None, "a", "en", 3, "x\ny"), (5, "", "", 0, ""), (5, "", "", 0, ""), (5, "", "en", 1, "z\n"), (-7, "é", "fr", 2, "ü\n\n")]
    for i in range(230):
        rows.append((rng.randrange(500), "hot", "en", i, "line\n" * rng.randrange(4)))
    for i in range(40):
        rows.append((i, f"s{i}", "de", i, "one\ntwo"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("depth", [1, 2, 7])
def test_manifest_brute_force(spark, depth):
    rows = manifest_rows()
    got = merkle.manifest(spark.createDataFrame(rows, FIELDS).repartition(4), depth).collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof, r.folded_root) for r in got), key=str) == brute_manifest(rows)
    # A version copies one node per level and nothing else: its leaf, its ancestors and its own root.
    for r in got:
        if r.copied is None:
            assert r.folded_root == r.root
        else:
            assert r.copied[-1] == r.folded_root != r.root and r.copied[0] != r.leaf


def test_a_version_shares_all_other_nodes():
    leaves = [sha(str(i)) for i in range(25)]
    block = merkle.Block(leaves, merkle.height(25))
    for at in range(25):
        changed = leaves[:at] + ["tampered"] + leaves[at + 1 :]
        again = merkle.Block(changed, merkle.height(25))
        copies = merkle.climb("tampered", block.path(at))
        for level, (old, new) in enumerate(zip(block.levels, again.levels)):
            differ = [i for i, (a, b) in enumerate(zip(old, new)) if a != b]
            assert differ == [at // 3**level] and new[differ[0]] == copies[level]
    assert block.levels == merkle.Block(leaves, merkle.height(25)).levels


def test_manifest_edges(spark):
    assert merkle.manifest(spark.createDataFrame([], FIELDS)).count() == 0
    one = merkle.manifest(spark.createDataFrame([(1, "s", "en", 1, "t", "x")], FIELDS + ", leaf string")).collect()[0]
    assert (one.leaf, one.subroot, one.root, one.proof) == (leaf_of((1, "s", "en", 1, "t")), one.leaf, one.leaf, "")


# Fill in the middle ----------------------------------------------------------------------------------------------------


def brute_fim(doc_id, text, rate=100, spm_rate=50):
    text = text or ""
    units = re.findall("[^\n]*\n|[^\n]+", text)
    h = sha(f"7:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text, text
    if h4 % 100 < spm_rate:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


@pytest.mark.parametrize("rate,spm_rate", [(100, 50), (60, 100), (100, 0), (0, 50)])
def test_fim_brute_force(spark, rate, spm_rate):
    rows = ODD + [(i, "".join(random.Random(i).choice("ab\n<PSM>é👍") for _ in range(i))) for i in range(20, 160)]
    got = fim.fill_in_middle(spark.createDataFrame(rows, DOCS), rate=rate, spm_rate=spm_rate)
    found = [tuple(r) for r in got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored").collect()]
    assert sorted(found, key=str) == sorted((brute_fim(d, t, rate, spm_rate) for d, t in rows), key=str)


def test_rotation_in_place():
    rng = random.Random(4)
    for _ in range(300):
        data = bytes(rng.randrange(256) for _ in range(rng.randrange(40)))
        at, middle, end = sorted(rng.randrange(len(data) + 1) for _ in range(3))
        block = bytearray(data)
        fim.rotate(block, at, middle, end)
        assert bytes(block) == data[:at] + data[middle:end] + data[at:middle] + data[end:]
        fim.rotate(block, at, at + end - middle, end)
        assert bytes(block) == data


def test_fim_long_text_and_columns(spark):
    text = "a line of a long text ü\n" * 200_000
    df = spark.createDataFrame([(1, text, "kept", 5)], "doc_id long, text string, extra string, n long")
    got = fim.fill_in_middle(df).collect()[0]
    assert got.restored == text and got.extra == "kept" and got.n == 200_000
    assert got.prefix_chars + got.middle_chars <= len(text)
    assert fim.fill_in_middle(spark.createDataFrame([], DOCS)).count() == 0

"""Each operator against a brute-force version, and the defined results of its edge cases."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from compare import differences, duck
from pyspark.sql import functions as F

from chorale.llm import (
    catalog, common, decontaminate, language, materialise, mixing, neighbours, paragraphs, quality, simhash, templates,
    urlfilter,
)

# A clashing name of every helper column kind, and an extra column.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, node string, keep int, __copy int"


def documents(spark, texts, start=0):
    rows = [(start + k, t, "en" if k % 2 else None, f"s{k % 3}" if k % 4 else None, 1, "x", "y", 2, 3)
            for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(seed, words):
    random = np.random.default_rng(seed)
    return " ".join("".join(random.choice(list("abcdefghij"), 5)) for _ in range(words)) + "."


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty and blank texts, repeated rows, a very long text, a null id."""
    same = prose(1, 60)
    docs = documents(spark, [None, "", " \n\t", same, same, same + " more", prose(2, 30_000), "one"])
    return docs.unionByName(docs.filter("doc_id = 3")).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def reach(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("name", ["op2_url_filter", "op6_mixing"])
def test_queries_agree_with_sql(spark, sf_dir, name):
    assert differences(catalog.queries()[name](spark, sf_dir), duck(sf_dir), catalog.oracle_sql()[name]) == []


def test_components(spark):
    random = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in random.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(400, 460)]
    found = dict(common.components(spark.createDataFrame(pairs, "a long, b long")).collect())
    want = reach(pairs, {x for p in pairs for x in p})
    assert {n: found.get(n, n) for n in want} == want


def test_components_join_few_rows(spark, monkeypatch):
    """Forests of many tasks over the same nodes: each names smallest nodes of its own, so nodes have many smaller ones."""
    random = np.random.default_rng(4)
    hubs, nodes = 60, 600
    pairs = [(int(h), int(x)) for x in range(hubs, nodes) for h in random.choice(hubs, 30, replace=False)]
    frame, made = spark.createDataFrame(pairs, "a long, b long"), []
    plain = type(frame).join

    def join(self, *args, **kwargs):
        out = plain(self, *args, **kwargs)
        made.append(out.count())
        return out

    monkeypatch.setattr(type(frame), "join", join)
    found = {tuple(r) for r in common.components(frame).collect()}
    assert found == {(x, 0) for x in range(1, nodes)}
    # 16,200 edges of 600 nodes.
    assert made and sum(made) < 8 * nodes


@pytest.mark.parametrize("size", [0, 1, 2, 50])
def test_components_of_odd_graphs(spark, size):
    """A largest node in the middle, a path in random order, loops, repeated and reversed edges, a negative and a null end."""
    random = np.random.default_rng(size)
    path = [int(x) for x in random.permutation(size) + 100]
    pairs = [(1_000, -k) for k in range(size)] + list(zip(path, path[1:], strict=False))
    pairs += [(b, a) for a, b in pairs] + pairs[:5] + [(7_000, 7_000)]
    want = reach(pairs, {x for p in pairs for x in p})
    rows = common.components(spark.createDataFrame([*pairs, (None, 8_000)], "a long, b long")).collect()
    assert {(r["node"], r["root"]) for r in rows} == {(n, m) for n, m in want.items() if n != m} and len(rows) == len({r["node"] for r in rows})


def test_word_count(spark):
    texts = [None, "", " ", "\t\n", "a", " a", "a ", " a  b c ", "x\x0by\x0cz"]
    counted = documents(spark, texts).orderBy("doc_id").select(common.word_count(F.col("text"))).collect()
    assert [r[0] for r in counted] == [0 if t is None else len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts]


# 1. Line templates

def test_templates_recur(spark, odd, none):
    own = [prose(k, 12) for k in range(12)]
    texts = [f"{own[k]}\nPosted by user {k} on day {k * 7} of May\n\nPosted by user {k} on day 3 of May\nshared {own[k]}"
             for k in range(12)]
    docs = documents(spark, texts)
    found = templates.recurring(docs, min_docs=10)
    assert {tuple(r) for r in templates.report(found).select("doc_id", "dropped").collect()} == {(k, 1) for k in range(12)}
    kept = templates.without_templates(docs, found)
    assert kept.columns == docs.columns
    assert {r["text"] for r in kept.collect()} == {f"{own[k]}\n\nshared {own[k]}" for k in range(12)}
    assert templates.recurring(odd, min_docs=2).filter("doc_id in (3, 4)").count() == 2
    assert templates.recurring(none).count() == 0


def test_lines_repeated_in_few_documents(spark):
    own = [prose(300 + k, 12) for k in range(8)]
    texts = [f"{own[0]}\n{own[1]}\nseen on day 4", f"{own[0]}\n{own[2]}\nseen on day 5", *[f"{own[3]}\n{own[4]}"] * 5, own[5], own[5]]
    docs = documents(spark, texts)
    # Rows of one doc_id are one document.
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") == 8, 7).otherwise(F.col("doc_id")))
    found = templates.recurring(docs)
    assert {(r["template"], r["docs"]) for r in found.collect()} == {
        (own[0], 2), (own[3], 5), (own[4], 5), ("seen on day <*>", 2)}
    assert found.count() == found.select("doc_id", "line").distinct().count() == 14
    after = {r["doc_id"]: r["text"] for r in templates.without_templates(docs, found).collect()}
    assert after == {0: own[1], 1: own[2], **{k: "" for k in range(2, 7)}, 7: own[5]}


def test_gather_generalises_words_and_keeps_strangers_apart():
    lines = ["user anna logged in today", "user bert logged in today", "user anna says good night"]
    assert templates.gather(lines) == ["user <*> logged in today"] * 2 + ["user anna says good night"]
    assert templates.gather(["a"]) == ["a"]


def test_templates_do_not_wear_down():
    base = "the red fox k1 k2 k3 v1 v2 v3 v4"
    twin = "the red fox k1 k2 k3 w1 w2 w3 w4"
    strangers = ["the red fox a1 a2 a3 a4 a5 a6 a7", "the red fox b1 b2 b3 b4 b5 b6 b7"]
    wide = "the red fox k1 k2 k3 <*> <*> <*> <*>"
    assert templates.gather([base, twin, *strangers]) == [wide, wide, *strangers]
    # Masked positions are no agreement either.
    masked = ["set the limit <*> <*> <*> <*> a b c", "set the limit <*> <*> <*> <*> d e f"]
    assert templates.gather(masked) == masked


def test_sliced_leaves_give_the_same_lines(spark):
    names = ["anna", "bert", "carl", "dora"]
    docs = documents(spark, [f"access granted to {names[k % 4]}{'x' * (k // 4)} for the main hall" for k in range(40)])
    one = templates.recurring(docs).select("doc_id", "line")
    many = templates.recurring(docs, slice_rows=7).select("doc_id", "line")
    assert sorted(one.collect()) == sorted(many.collect()) and one.count() == 40


# 2. URL lists over time

def test_url_lists_over_time(spark):
    captures = spark.sql("""select * from values
        (1, 'https://User@A.Example.com:80/x/y/z.html?q#f', timestamp '2024-01-05'), (1, 'https://a.example.com/x', timestamp '2024-01-01'),
        (2, 'http://a.example.com/x/y', timestamp '2024-01-10'), (3, null, timestamp '2024-01-05'), (4, 'no url', timestamp '2024-01-05'),
        (5, 'http://a.example.com', null), (6, 'http://other.org', timestamp '2024-01-05'), (6, 'http://other.org', timestamp '2024-01-05')
        as t(page_id, url, fetched_at)""").withColumn("key", F.lit("clash"))
    entries = spark.sql("""select *, 'x' as url from values
        ('example.com', 'add', timestamp '2024-01-02'), ('example.com', 'remove', timestamp '2024-01-08'),
        ('a.example.com/x/', 'add', timestamp '2024-01-05'), ('a.example.com/x/', 'add', timestamp '2024-01-06'),
        ('other.org', 'add', timestamp '2024-01-05'), ('other.org', 'remove', timestamp '2024-01-05'),
        (null, 'add', timestamp '2024-01-01'), ('no', 'add', null), ('org', 'note', timestamp '2024-01-01') as t(key, action, listed_at)""")
    for rows in (1_000_000, 1):
        got = {(r["page_id"], str(r["fetched_at"])[:10]): r["matches"] for r in urlfilter.screened(captures, entries, rows).collect()}
        assert got == {(1, "2024-01-05"): ["a.example.com/x/", "example.com"], (1, "2024-01-01"): [],
                       (2, "2024-01-10"): ["a.example.com/x/"], (3, "2024-01-05"): [], (4, "2024-01-05"): [],
                       (5, "None"): [], (6, "2024-01-05"): []}
    assert urlfilter.allowed(captures, entries).count() == 6
    assert urlfilter.screened(captures, entries.limit(0)).filter("blocked").count() == 0
    assert urlfilter.screened(captures.limit(0), entries).count() == 0


# 3. Paragraphs

def test_paragraphs_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = paragraphs.repeats(docs).collect()
    got = {(r["doc_id"], r["paragraph"]): (r["class_doc_id"], r["class_paragraph"]) for r in found if r["whole"]}
    units, place = {}, defaultdict(list)
    for doc, text in docs.select("doc_id", "text").collect():
        for number, _, _, words in paragraphs.paragraphs_of(text):
            key = b" ".join(words)
            units[key] = {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))}
            place[key].append((doc, number))
    by, pairs = defaultdict(set), set()
    for key, own in units.items():
        for s in own:
            pairs |= {(key, other) for other in by[s]}
            by[s].add(key)
    near = [(a, b) for a, b in pairs if len(units[a] & units[b]) >= 0.8 * len(units[a] | units[b])]
    classes = defaultdict(list)
    for key, top in reach(near, units).items():
        classes[top] += place[key]
    want = {p: min(c) for c in classes.values() if len(c) > 1 for p in c}
    missed = sum(got.get(p) != w for p, w in want.items())
    assert missed <= 0.01 * len(want) and set(got) <= set(want)
    # Every piece stands word for word in the paragraph named as the one that stays, and in `copies` places.
    texts = dict(docs.select("doc_id", "text").collect())
    pieces = [(texts[r["doc_id"]][r["start"]:r["end"]].lower().split(), r) for r in found if not r["whole"]]
    for words, r in pieces:
        assert len(words) > paragraphs.REACH
        home = texts[r["class_doc_id"]].split("\n")[r["class_paragraph"]].lower().split()
        assert f" {' '.join(words)} " in f" {' '.join(home)} "
        assert r["copies"] == sum(other == words for other, _ in pieces)


def test_passage_in_the_middle_of_paragraphs(spark):
    """A passage of 60 words within paragraphs that have nothing else in common."""
    passages = [prose(900 + k, 60)[:-1] for k in range(20)]
    texts = [f"{prose(1_000 + k, 80)} {passages[k % 20]} {prose(2_000 + k, 90)}" for k in range(60)]
    docs = documents(spark, [*texts, *[prose(3_000 + k, 200) for k in range(20)]])
    found = paragraphs.repeats(docs)
    rows = found.collect()
    hit = {r["doc_id"] for r in rows}
    assert len(hit) >= 57 and not any(i >= 60 for i in hit) and not any(r["whole"] for r in rows)
    for r in rows:
        assert texts[r["doc_id"]][r["start"]:r["end"]] in passages[r["doc_id"] % 20]
    after = dict(paragraphs.without_repeats(docs, found).select("doc_id", "text").collect())
    for i, text in enumerate(texts):
        own = sorted((r["start"], r["end"]) for r in rows if r["doc_id"] == i and r["removed"])
        want, at = "", 0
        for a, b in own:
            want, at = want + text[at:a], b
        assert after[i] == want + text[at:]
    assert all(after[i] == texts[i] for i in range(20))


def test_passages_across_line_feeds(spark):
    """A passage of 80 words wrapped at 9 words in one document and at 13, or into lines of 4, in others."""
    wrap = lambda words, n: "\n".join(" ".join(words[k:k + n]) for k in range(0, len(words), n))
    texts, passages = [], [prose(5_000 + k, 80)[:-1].split() for k in range(10)]
    for k, passage in enumerate(passages):
        for j, n in enumerate((9, 13, 4)):
            texts.append(wrap([*prose(6_000 + 3 * k + j, 30 + k).split(), *passage, *prose(7_000 + 3 * k + j, 25).split()], n))
    docs = documents(spark, texts)
    found = paragraphs.passages(docs)
    rows = [r for r in found.collect() if r["removed"]]
    assert not any(r["whole"] for r in rows)
    for i, text in enumerate(texts):
        words = [w for r in rows if r["doc_id"] == i for w in text[r["start"]:r["end"]].split()]
        assert set(words) <= set(passages[i // 3])
        # All but the words before the first cut and behind the last one.
        assert not words if i % 3 == 0 else len(words) > 40
    after = dict(paragraphs.without_repeats(docs, found).select("doc_id", "text").collect())
    for i, text in enumerate(texts):
        gone = Counter(w for r in rows if r["doc_id"] == i for w in text[r["start"]:r["end"]].split())
        assert Counter(after[i].split()) == Counter(text.split()) - gone


def test_removed_paragraphs_go_with_their_line_feed(spark):
    same = prose(5, 12)
    docs = documents(spark, [same, f"a\n{same}\nb", f"c\n{same}", f"{same}\n{same}", f"\n{same}"])
    after = dict(paragraphs.without_repeats(docs, paragraphs.repeats(docs)).select("doc_id", "text").collect())
    assert after == {0: same, 1: "a\nb", 2: "c", 3: "", 4: ""}


def test_paragraph_edges(spark, odd, none):
    found = paragraphs.repeats(odd)
    assert {(r["doc_id"], r["class_doc_id"], r["removed"]) for r in found.collect()} == {
        (3, 3, False), (4, 3, True), (5, 3, True)}
    assert paragraphs.repeats(none).count() == 0
    cut = paragraphs.without_repeats(odd, found)
    assert cut.columns == odd.columns and cut.count() == odd.count()
    assert [r["text"] for r in cut.filter("doc_id in (4, 5)").collect()] == ["", ""]


def test_places_of_words():
    for text in ("", " ", "a", " é語 b\tc\x0bd\x1ce 😀\n", "x\ud800 y", "one two", "\n\nend"):
        begins, ends = paragraphs.word_places(text)
        want = [m.span() for m in re.finditer("[^\x20\x09-\x0D]+", text)]
        assert list(zip(begins.tolist(), ends.tolist(), strict=True)) == want


def test_small_buckets_give_the_labels_of_the_index(monkeypatch):
    random = np.random.default_rng(0)
    cases = []
    for _ in range(300):
        base = random.integers(0, 60, 30)
        cases.append([np.unique(random.choice(base, int(random.integers(0, 31)), replace=False)).astype(np.uint64)
                      for _ in range(random.integers(2, 7))])
    small = [paragraphs._labels(sets, 0.8).tolist() for sets in cases]
    monkeypatch.setattr(paragraphs, "FEW", 0)
    assert small == [paragraphs._labels(sets, 0.8).tolist() for sets in cases]


def test_large_buckets_are_split_without_losing_links(spark):
    base = prose(4, 60).split()
    texts = [" ".join([*base[:k], f"w{k}", *base[k + 1:]]) for k in range(0, 60, 2)]
    one = paragraphs.repeats(documents(spark, texts))
    many = paragraphs.repeats(documents(spark, texts), bucket_rows=4)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect())) and one.filter("copies = 30").count() == 30


def hash_sets(spark, sets):
    rows = [(7, k, np.unique(np.array(s, np.uint64)).tobytes()) for k, s in enumerate(sets)]
    return spark.createDataFrame(rows, "value long, unit long, shingles binary")


def test_edges_of_close_sets_grow_with_the_sets(spark):
    """n close sets in blocks of 20: less than two edges a set at any n."""
    for n in (200, 400, 800):
        close = [[*range(1, 60), 1000 + k] for k in range(n)]
        edges = paragraphs.jaccard_links(hash_sets(spark, close), 0.8, 20).distinct().collect()
        assert len(set(reach([tuple(e) for e in edges], range(n)).values())) == 1
        assert len(edges) < 1.2 * n


def test_links_of_a_mixed_bucket_against_brute_force(spark):
    """Two groups, a chain and strangers in one bucket, cut into blocks of any size."""
    random = np.random.default_rng(3)
    sets = [[*range(1, 40), 1000 + k] for k in range(60)] + [[*range(100, 140), 2000 + k] for k in range(25)]
    sets += [list(range(300 + 3 * k, 340 + 3 * k)) for k in range(30)]
    sets += [random.integers(10_000, 20_000, 40).tolist() for _ in range(20)] + [list(range(1, 36)), []]
    sets = [sets[k] for k in random.permutation(len(sets))]
    own = [set(s) for s in sets]
    near = [(a, b) for a in range(len(own)) for b in range(a) if own[a] & own[b]
            and len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b]) - 1e-9]
    want = reach(near, range(len(own)))
    for rows in (1000, 30, 5):
        edges = [tuple(e) for e in paragraphs.jaccard_links(hash_sets(spark, sets), 0.8, rows).collect()]
        assert reach(edges, range(len(own))) == want


# 4. Neighbours

def exact(vectors, query, top):
    own = vectors[query]
    scored = [(-float(np.dot(own, v)), i) for i, v in vectors.items() if i != query]
    return [i for _, i in sorted(scored)[:top]]


def test_neighbour_recall(spark):
    random = np.random.default_rng(0)
    rows = [(i, [float(x) for x in random.normal(size=16)]) for i in range(3_000)]
    rows += [(10_000 + i, rows[7][1]) for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vectors = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    got = defaultdict(list)
    for r in neighbours.nearest(frame, F.col("vec_id") % 20 == 0, least=400, leaf_rows=128).orderBy("query_id", "rank").collect():
        assert abs(r["score"] - vectors[r["query_id"]] @ vectors[r["vec_id"]]) < 1e-12
        got[r["query_id"]].append(r["vec_id"])
    assert set(got) == {i for i in vectors if i % 20 == 0} and all(len(x) == 20 for x in got.values())
    hits = sum(len(set(got[q]) & set(exact(vectors, q, 20))) for q in got)
    assert hits >= 0.9 * 20 * len(got)
    assert got[10_000] == exact(vectors, 10_000, 20) and 7 in got[10_000]


def test_neighbour_edges(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (20, [0.5, 0.5]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]),
            (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0]), (7, [-1.0, 0.0]), (None, [1.0, 0.0]), (40, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    got = [tuple(r) for r in neighbours.nearest(frame, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20, 0.5), (0, 2, 7, -1.0), (20, 1, 0, 0.5), (20, 2, 7, -0.5)]
    assert neighbours.nearest(frame.limit(0), F.lit(True)).count() == 0


# 5. SimHash

def test_covering_meets_all_close_pairs():
    random = np.random.default_rng(1)
    for covering, bits in ((simhash.HALVES, 32), (simhash.EIGHTS, 23)):
        x = random.integers(0, 1 << bits, 200)
        for flips in range(covering.threshold + 1):
            y = x.copy()
            for k in range(len(y)):
                for b in random.choice(bits, flips, replace=False):
                    y[k] ^= 1 << int(b)
            row, anchor, home = simhash.anchors_of(x, covering)
            homes = dict(zip(row[home].tolist(), anchor[home].tolist(), strict=True))
            assert home.sum() == len(x)
            row, anchor, _ = simhash.anchors_of(y, covering)
            assert all(homes[k] in anchor[row == k] for k in range(len(x)))


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    runs = [" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_brute_force(spark, sf_dir):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in catalog.op5_simhash(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    prints = {d: plain_print(t) for d, t in docs}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    roots = reach(near, prints)
    assert got == {d: (f"{prints[d]:016x}", roots[d]) for d in prints}


def test_simhash_edges(spark, odd, none):
    got = simhash.near_duplicates(odd)
    assert got.count() == odd.count()
    rows = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got.collect()}
    assert [rows[k] for k in (0, 1, 2, None)] == [(0, 0)] * 4 and rows[4][1] == 3
    assert simhash.near_duplicates(none).count() == 0


def test_split_anchors_link_the_same(spark):
    random = np.random.default_rng(2)
    base = [int(x) for x in random.integers(0, 1 << 62, 20)]
    prints = sorted({b ^ (1 << int(k)) for b in base for k in random.integers(0, 62, 15)})
    frame = spark.createDataFrame([(p, p.to_bytes(8, "big")) for p in prints], "node long, bits binary").withColumn("seek", F.col("bits"))
    near = [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 4]
    want = reach(near, prints)
    for rows in (20_000, 3):
        found = dict(common.components(simhash.links(frame, simhash.HALVES, 4, rows)).collect())
        assert {p: found.get(p, p) for p in prints} == want


def test_one_of_each_group_stays(spark, odd):
    base = prose(9, 400).split()
    near = [" ".join([*base[:k], "new", *base[k + 1:]]) for k in (50, 150, 350)]
    docs = documents(spark, [" ".join(base), *near, prose(10, 400), prose(11, 400)])
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect()) == [0, 4, 5]
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert Counter(ids) == Counter([0, 3, 6, 7, None])


def test_near_copies_by_exact_similarity(spark):
    """An appended block at just over 0.8, few distinct words in the document; and pairs at just below 0.8."""
    random, texts = np.random.default_rng(8), []
    for k in range(80):
        size = int(random.integers(60, 300))
        words = [f"{k}w{x}" for x in (random.integers(0, 40, size) if k % 2 else range(size))]
        runs = len({tuple(words[i:i + 5]) for i in range(size - 4)})
        # runs / (runs + added): 0.8 or just above, then 0.77 or just below.
        texts += [" ".join(words), " ".join(words + [f"{k}n{x}" for x in range(runs // 4 if k < 40 else -(-runs * 23 // 77))])]
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(documents(spark, texts)).collect()}
    linked = [found[2 * k] == found[2 * k + 1] for k in range(80)]
    assert sum(linked[:40]) >= 39 and not any(linked[40:])
    # Rows without an id are compared as well.
    nulls = documents(spark, [texts[0], texts[1]]).withColumn("doc_id", F.lit(None).cast("long"))
    both = simhash.similar_documents(nulls.unionByName(documents(spark, [texts[1]], start=9))).collect()
    assert [r["component_id"] for r in both] == [9, 9, 9]


def test_one_of_each_follows_fingerprints_too(spark):
    """A group stays together over links of 4 or fewer of 64 bits and over exact similarity, whichever a pair has."""
    common_words, texts = "the same few words come again and again in this text ", []
    for k in range(6):
        # Repeats decide the fingerprint; the sets have less than 0.8 in common.
        texts += [common_words * 60 + prose(100 + 2 * k, 12), common_words * 60 + prose(101 + 2 * k, 12)]
    long = prose(200, 300)
    # Alike by their sets, not by their fingerprints: a block that is new at the end.
    texts += [long, long + " " + prose(201, 60), prose(202, 300), prose(203, 300)]
    docs = documents(spark, texts)
    prints = [plain_print(t) for t in texts]
    near = [(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    alone = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()}
    assert any(alone[a] != alone[b] for a, b in near) and (prints[12] ^ prints[13]).bit_count() > 4 and alone[13] == 12
    want = reach(near + list(alone.items()), range(len(texts)))
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs).collect()} == want
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect()) == sorted(set(want.values()))
    # Rows without an id take part.
    bridge = documents(spark, [texts[0], texts[1], texts[1]]).withColumn("doc_id", F.expr("case doc_id when 0 then 5 when 2 then 9 end"))
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in simhash.near_copies(bridge).collect()) == [(0, 5), (5, 5), (9, 5)]


# 6. Mixing

def test_mixing_targets_and_caps(spark, odd, none):
    texts = [prose(k, 5 + k % 40) for k in range(600)]
    docs = documents(spark, texts).withColumn("source", F.expr("case when doc_id % 100 < 60 then 'a' when doc_id % 100 < 62 then 'b' when doc_id % 100 < 70 then null else 'c' end"))
    rows = mixing.mix(docs).collect()
    total = sum(r["size"] for r in rows)
    per = {r["source"]: (r["source_size"], r["target"]) for r in rows}
    taken = Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
    assert abs(sum(t for _, t in per.values()) - total) < 1e-6 * total
    assert all(t <= 3 * s + 1e-9 for s, t in per.values()) and all(abs(taken[s] - t) <= 60 for s, (_, t) in per.items())
    free = {s: t for s, (z, t) in per.items() if t < 3 * z}
    weight = {"a": 1, "b": 2, "c": 3, None: 1}
    assert len({round(t / weight[s], 6) for s, t in free.items()}) == 1 and per["b"][1] == 3 * per["b"][0]
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    stream = mixing.mixed(docs)
    assert stream.columns == docs.columns
    assert Counter(r["doc_id"] for r in stream.collect()) == Counter({r["doc_id"]: r["times"] for r in rows if r["times"]})
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(none).count() == 0
    assert {r["taken"] for r in mixing.mix(odd).filter("size = 0").collect()} == {0}
    assert mixing.mix(documents(spark, [None, ""])).agg(F.sum("taken"), F.sum("target")).first() == (0, 0.0)


# 7. Training order

@pytest.mark.parametrize("total", [1, 2, 3, 1_000, 4_096, 4_097])
def test_permutation(total):
    out = materialise.permute(np.arange(total), total, 5)
    assert sorted(out) == list(range(total))
    assert total < 1_000 or (out != materialise.permute(np.arange(total), total, 6)).any()


@pytest.mark.parametrize("keep", [False, True])
def test_round_trip_through_shards(spark, odd, none, tmp_path, keep):
    path = str(tmp_path / f"out{keep}")
    docs = odd.repartition(3)
    index = materialise.materialise(docs, path, length=64, per_shard=100, keep=keep)
    rows = sorted(index.collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in rows] == list(range(len(rows)))
    tokens = list(materialise.read_slots(spark, path, 0, len(rows)))
    assert [xxhash.xxh64_intdigest(t.tobytes(), 42) & (1 << 64) - 1 for t in tokens] == [r["checksum"] & (1 << 64) - 1 for r in rows]
    assert [t.tobytes() for t in materialise.read_slots(spark, path, 95, 10)] == [t.tobytes() for t in tokens[95:105]]
    ends = sum(int((t == 0xFF).sum()) for t in tokens)
    assert ends == odd.filter("text <> ''").count()
    letters = Counter(b"".join(t.tobytes() for t in tokens))
    want = Counter("".join(r["text"] or "" for r in odd.collect()).encode())
    assert {k: v for k, v in letters.items() if k < 0xFE} == want
    assert all(r["shard"] == r["slot"] // 100 and r["offset"] == r["slot"] % 100 * 65 for r in rows)
    assert materialise.materialise(none, f"{path}-none").count() == 0


def test_public_vocabulary(spark, tmp_path):
    tokenizers = pytest.importorskip("public_tokenizers")
    encoder = materialise.bpe(tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = [prose(k, 200) for k in range(3)]
    path = str(tmp_path / "bpe")
    materialise.materialise(documents(spark, texts).coalesce(1), path, encoder, length=32, keep=True).count()
    about = spark.read.json(f"{path}/about").first()
    order = materialise.permute(np.arange(about["sequences"]), about["sequences"], about["key"])
    slots = list(materialise.read_slots(spark, path, 0, about["sequences"]))
    ids = np.concatenate([slots[s] for s in order]).tolist()
    known, out = materialise._ranks(tokenizers.path("byte_bpe_50k.tiktoken")), [[]]
    for token in ids:
        if token == encoder.end:
            out.append([])
        elif token != encoder.pad:
            out[-1].append(token)
    assert sorted(known.decode(x) for x in out if x) == sorted(texts)


# 8. Language

def test_language_held_out_accuracy(spark, sf_dir, none):
    found = catalog.op8_language(spark, sf_dir)
    langs = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect())
    rows = found.collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) >= 0.97 * len(held)
    model = language.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.lit(True), per_language=20)
    assert [model.predict(t)[:2] for t in (None, "", "12 !?\n", " ")] == [("und", 0.0)] * 4
    empty = language.fit(none, F.lit(True))
    assert language.predicted(none, empty).count() == 0 and empty.predict("hello")[0] == "und"


def test_language_edges_and_blocks(spark, odd, monkeypatch):
    model = language.fit(odd, F.lit(True))
    got = {r["doc_id"]: r["lang_pred"] for r in language.predicted(odd, model).collect()}
    assert got[0] == got[1] == got[2] == got[None] == "und" and got[6] == "en"
    text = prose(3, 500)
    whole = language.counts_of(text)
    monkeypatch.setattr(language, "_BLOCK", 100)
    assert (language.counts_of(text) == whole).all()


# 9. Quality

def test_quality_against_labels(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = dict(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality").collect())
    rows = [r for r in quality.scored(docs).collect() if r["doc_id"] in labels]
    good = [r["keep"] for r in rows if labels[r["doc_id"]]]
    bad = [r["keep"] for r in rows if not labels[r["doc_id"]]]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.05 * len(bad)


def test_quality_edges(spark, odd, none):
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert {r["score"] for r in quality.scored(odd).filter("doc_id in (0, 1, 2, 7)").collect()} == {1.0}
    assert quality.scored(none).count() == 0


def test_short_and_unbroken_texts_are_judged():
    junk = ["ndtion. | Erndnd | thndonea. |", "Tación Tación dota dota que que del del ñra, ñra, jaja jaja",
            "QUJD" * 5_000, "哈" * 5_000]
    fine = ["This.", "Eser thed nt of.", "今天天气很好。我们去公园散步，然后回家吃饭。", "one"]
    assert all(-1 in quality.votes(t.encode()) for t in junk)
    assert not any(-1 in quality.votes(t.encode()) for t in fine)
    posterior = {quality.pattern_of(t.encode()): 0.1 for t in junk}
    model = quality.Model(None, 0.0, 1.0, posterior)
    assert [model.score(t) for t in junk + fine] == [0.1] * 4 + [1.0] * 4


# 10. Decontamination

def plain_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != t))
    return min(row)


def test_bit_parallel_distance():
    random = np.random.default_rng(8)
    for _ in range(200):
        pattern = "".join(random.choice(list("abc"), random.integers(1, 90)))
        text = "".join(random.choice(list("abc"), random.integers(0, 120)))
        want = plain_distance(pattern, text)
        assert decontaminate.ends(pattern, text, want - 1) is None
        distance, start, end = decontaminate.find(pattern, text, want)
        assert distance == want and plain_distance(pattern, text[start:end]) == want


def test_edited_passages_are_found(spark, odd, none):
    items = [prose(k, 30) for k in range(40, 44)]
    bench = spark.createDataFrame([(k, t, "x") for k, t in enumerate([*items, None, "", "short", items[0]])], "item_id long, text string, doc_id string")
    budget = len(decontaminate.normal(items[1])) // decontaminate.CHARS_PER_EDIT
    edited = list(items[1])
    for k in np.linspace(3, len(edited) - 3, budget).astype(int):
        edited[k] = "#"
    docs = documents(spark, [prose(50, 50) + items[0].upper().replace(" ", "\n ") + prose(51, 50), "".join(edited),
                             "".join(edited).replace("i", "?"), items[2][:60] + prose(52, 40), prose(53, 4_000) + " " + items[3]])
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.contaminated(docs, bench, block_chars=200).collect()}
    assert got == {(0, 0): 0, (0, 7): 0, (1, 1): budget, (4, 3): 0}
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == [2, 3]
    assert decontaminate.contaminated(odd, bench).count() == 0 and decontaminate.decontaminate(odd, bench).count() == odd.count()
    assert decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.decontaminate(docs, bench.limit(0)).count() == 5


def test_decontamination_against_search(spark, sf_dir):
    got = {(r["doc_id"], r["item_id"]) for r in catalog.op10_decontamination(spark, sf_dir).filter("distance = 0").collect()}
    con = duckdb.connect()
    docs = con.execute(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()
    items = con.execute(f"select item_id, text from '{sf_dir}/benchmark.parquet'").fetchall()
    norm = decontaminate.normal
    assert got == {(d, i) for d, t in docs for i, x in items if norm(x) in norm(t)}

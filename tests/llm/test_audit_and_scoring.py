"""Language-model scoring, divergence audit and lexical search against brute force; orders that must not matter."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import differences, duck
from pyspark.sql import functions as F

from chorale.llm import catalog, divergence, language, lexical, mixing, neighbours, ngrams, quality, templates

# A clashing name of helper columns, and extra columns.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, block int, score string, kind string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, g, s, 1, 2, "x", "y") for i, t, g, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, blanks, repeated rows, ties, a very long text, null ids, languages and sources."""
    many = " ".join(f"w{k % 700} common" for k in range(20_000))
    rows = [(0, None, "en", "a"), (1, "", "en", None), (2, " \n\t", None, "b"), (3, "One two two THREE", "en", "a"),
            (3, "One two two THREE", "en", "a"), (4, "one two two three", "en", "b"), (5, many, "en", "b"),
            (None, "one two", "fr", "a"), (6, "été été ONE 12 12a", None, None), (7, "one", "fr", "b")]
    return documents(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", ["op12_divergence", "op13_search"])
def test_queries_agree_with_sql(spark, sf_dir, name):
    assert differences(catalog.queries()[name](spark, sf_dir), duck(sf_dir), catalog.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", ["op2_url_filter", "op6_mixing"])
def test_native_plans(spark, sf_dir, name):
    plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for odd_one in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "InPandas"):
        assert odd_one not in plan


# 11. Language model

class Plain:
    """Interpolated modified Kneser-Ney over dictionaries."""

    def __init__(self, texts, order):
        self.order, self.grams, self.raw = order, [defaultdict(Counter) for _ in range(order + 1)], Counter()
        for text in texts:
            seq = ["<s>", *self.tokens(text)]
            self.raw.update(seq[1:])
            for i in range(1, len(seq)):
                for k in range(2, order + 1):
                    if i >= k - 1 and (k == order or i == k - 1):
                        self.grams[k][tuple(seq[i - k + 1:i])][seq[i]] += 1
        for k in range(order, 1, -1):
            for context, words in self.grams[k].items():
                for word in words:
                    self.grams[k - 1][context[1:]][word] += 1
        self.n, self.v, self.cut, self.sums = sum(self.raw.values()), len(self.raw), {}, {}
        for k in range(1, order + 1):
            seen = Counter(c for words in self.grams[k].values() for c in words.values())
            self.cut[k] = ngrams.discounts_of(tuple(seen[c] for c in (1, 2, 3, 4)))

    @staticmethod
    def tokens(text):
        return [*re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()), "</s>"]

    def taken(self, k, count):
        return self.cut[k][min(count, 3) - 1] if count else 0

    def chance(self, context, word):
        k = len(context) + 1
        lower = self.chance(context[1:], word) if context else 1 / (self.v + 1)
        words = self.grams[k].get(context)
        if not words:
            return lower
        if context not in self.sums:
            self.sums[context] = sum(words.values()), sum(self.taken(k, c) for c in words.values())
        total, rest = self.sums[context]
        count = words.get(word, 0)
        return (max(count - self.taken(k, count), 0) + rest * lower) / total

    def row(self, text):
        seq = ["<s>", *self.tokens(text)]
        score = sum(math.log10(self.chance(tuple(seq[max(0, i - self.order + 1):i]), seq[i])) for i in range(1, len(seq)))
        base = sum(math.log10((self.raw[w] + 1) / (self.n + self.v + 1)) for w in seq[1:])
        return len(seq) - 1, sum(self.raw[w] > 0 for w in seq[1:]), self.n, base, score


@pytest.mark.parametrize("order", [2, 3])
def test_language_model_against_brute_force(spark, sf_dir, order):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    held_out = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    plain = Plain([t for i, t in rows if i not in held_out], order)
    # Many shards and chunks, so that frequent words are spread.
    model = ngrams.fit(docs, F.crc32(F.col("doc_id").cast("string")) % 7 != 2, order, shard_bytes=60_000, chunk=20_000)
    assert model.shards > 5 and len(model.frequent) > 1
    for r in ngrams.scored(docs, model, chunk=30_000).collect():
        want = plain.row(next(t for i, t in rows if i == r["doc_id"]))
        assert tuple(r)[1:4] == want[:3]
        assert tuple(r)[4:6] == pytest.approx(want[3:], rel=1e-9)
    words = [*plain.raw, b"never seen"]
    some = plain.tokens(rows[0][1])
    for context in (("<s>",)[:order - 1], tuple(some[:order - 1])):
        assert sum(plain.chance(context, w) for w in words) == pytest.approx(1)
    assert sum(plain.row(t)[4] for i, t in rows if i in held_out) > sum(plain.row(t)[3] for i, t in rows if i in held_out)


def test_language_model_edges(spark, odd, none, tmp_path):
    model = ngrams.fit(odd, F.col("doc_id") != 6, folder=f"file:{tmp_path}/model")
    assert (tmp_path / "model" / "words-0").exists()
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    plain = Plain([t for i, t in rows if i is not None and i != 6], 2)  # a null id doesn't train
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["score"], r["base_score"], r["n_tokens"], r["n_known"])
                  for r in ngrams.scored(odd, model).collect()))
    want = sorted((i is None, i or 0, (x := plain.row(t))[4], x[3], x[0], x[1]) for i, t in rows)
    assert [g[:2] + g[4:] for g in got] == [w[:2] + w[4:] for w in want]
    assert np.allclose([g[2:4] for g in got], [w[2:4] for w in want], rtol=1e-9)
    assert ngrams.scored(none, model).count() == 0
    empty = ngrams.scored(odd, ngrams.fit(none, F.lit(True))).collect()
    assert len(empty) == 10 and all((r["score"], r["base_score"], r["train_tokens"], r["n_known"]) == (0, 0, 0, 0) for r in empty)
    with pytest.raises(ValueError, match="mapped"):
        ngrams.fit(odd, F.lit(True), folder="hdfs://store/model")
    with pytest.raises(ValueError, match="order"):
        ngrams.fit(odd, F.lit(True), order=1)


# 12. Divergence

def plain_audit(rows, min_docs, top):
    rows = [(g or "", s or "", re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
            for _, t, g, s in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        held, counts = Counter(), defaultdict(Counter)
        for g, s, terms in rows:
            if g == lang:
                held.update(set(terms))
                counts[s].update(terms)
        kept = sorted(t for t, n in held.items() if n >= min_docs)
        counts = {s: {t: c[t] for t in kept} for s, c in counts.items()}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        p = {s: share(c) for s, c in counts.items()}
        q = share({t: sum(c[t] for c in counts.values()) for t in kept})
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = [(sum(f(p[s][t], p[x][t]) for t in kept), x) for x in counts if x != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, x, v, k) for k, (v, x) in enumerate(found, 1) if part == "pair" or k <= top}
    return out


def test_divergence_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]
    want = plain_audit(rows, 4, 3)
    for sizes in ({}, {"group_rows": 3, "block_bytes": 70_000, "chunk": 5_000}):
        got = [tuple(r) for r in divergence.audit(docs, min_docs=4, top=3, **sizes).collect()]
        assert len(got) == len(want) and set(got) == want


def test_divergence_edges(spark, odd, none):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in odd.collect()]
    got = [tuple(r) for r in divergence.audit(odd, min_docs=2, group_rows=1).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_audit(rows, 2, 10)
    # No kept term at all: every pair is there with 0.
    bare = [tuple(r) for r in divergence.audit(odd).collect()]
    assert {r[4] for r in bare if r[2] == "pair"} == {0} and set(bare) == plain_audit(rows, 10, 10)
    assert divergence.audit(none).count() == 0


def test_shares_are_exact():
    random = np.random.default_rng(2)
    for total in (1, 7, 10**9 + 7, 9 * 10**15):
        counts = np.append(random.integers(0, max(1, total - 1), 50), [0, max(0, total - 2)])
        assert divergence.shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 2) // total for c in counts]


# 13. Lexical search

def plain_search(docs, items, top):
    term = re.compile(rb"[0-9a-z\x80-\xff]+")
    own = [(i, Counter(term.findall((t or "").encode().lower()))) for i, t in docs]
    own = [x for x in own if x[1]]
    size, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in set(items):
        asked = Counter(term.findall((text or "").encode().lower()))
        scores = []
        for i, c in own:
            m = 100 - 75 + 75 * sum(c.values()) * size // total
            score = sum(n * math.floor(1000 * math.log((2 * size + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t, n in asked.items() if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, k, None if x[1] else x[2], -x[0]) for k, x in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def test_search_against_brute_force(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "benchmark"))
    want = plain_search([tuple(r) for r in docs.select("doc_id", "text").collect()],
                        [tuple(r) for r in items.select("item_id", "text").collect()], 10)
    for sizes in ({}, {"bucket": 16, "head": 0.2, "focus": 30}, {"block_chars": 900, "focus": 0}):
        got = [tuple(r) for r in lexical.search(docs, items, **sizes).collect()]
        assert sorted(got, key=str) == want


def test_search_prunes(spark, sf_dir):
    """Buckets behind the reach of a query are left out, and what is left out could not have been among the best."""
    docs = [Counter({0: 1 + k % 5, 1: k % 3, 2: 1}) for k in range(500)] + [Counter({3: 9, 4: 9}) for _ in range(20)]
    x = [{t: int(lexical.impacts(np.array([n]), sum(d.values()), 520, 3000)[0]) for t, n in d.items() if n} for d in docs]
    weights = np.array([20, 900, 40, 7000, 6000])
    length = [math.sqrt(sum(v * v * weights[t] for t, v in d.items())) for d in x]
    import pandas as pd
    rows = pd.DataFrame({"doc_id": pd.array(range(520), "Int64"), "length": length, "vector": [
        np.array([sorted(d), [d[t] for t in sorted(d)]], "<u4").tobytes() for d in x]}).sort_values("length", ascending=False)
    bucket = lexical.Bucket(rows.reset_index(drop=True), np.sqrt(weights))
    query = lexical.Query(Counter({b"c": 1, b"d": 2}), {b"c": 3, b"d": 4}, weights)
    every = bucket.scores(query, np.ones(520, bool))
    least = int(np.sort(every)[-10])
    alive = bucket.survivors(query, least, 2)
    assert alive.sum() == 20 and (every[~alive] < least).all()


def test_bounds_leave_no_document_out():
    """Random documents, queries and thresholds: whoever reaches the threshold survives."""
    import pandas as pd

    random, left_out = np.random.default_rng(8), 0
    for _ in range(300):
        weights = random.integers(1, 9_000, 6)
        x = [{int(t): int(random.integers(1, 1_000_000)) for t in random.permutation(6)[:random.integers(1, 7)]} for _ in range(30)]
        length = [math.sqrt(sum(v * v * weights[t] for t, v in d.items())) for d in x]
        rows = pd.DataFrame({"doc_id": pd.array(range(30), "Int64"), "length": length, "vector": [
            np.array([sorted(d), [d[t] for t in sorted(d)]], "<u4").tobytes() for d in x]})
        bucket = lexical.Bucket(rows.sort_values("length", ascending=False).reset_index(drop=True), np.sqrt(weights))
        asked = {b"%d" % t: int(random.integers(1, 4)) for t in random.permutation(6)[:random.integers(1, 7)]}
        query = lexical.Query(Counter(asked), {b"%d" % t: t for t in range(6)}, weights)
        every = bucket.scores(query, np.ones(30, bool))
        for least in (1, int(np.median(every)), int(every.max())):
            alive = bucket.survivors(query, least, int(random.integers(0, 6)))
            assert alive[every >= least].all()
            left_out += int((~alive).sum())
    assert left_out > 1_000


def test_search_edges(spark, odd, none):
    items = spark.createDataFrame([(1, "ONE two", "z"), (1, "ONE two", "z"), (2, None, "z"), (3, " .", "z"), (4, "nowhere", "z"),
                                   (None, "été 12a two two", "z"), (5, "common", "z")], "item_id long, text string, rank string")
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = sorted((tuple(r) for r in lexical.search(odd, items, bucket=2).collect()), key=str)
    assert got == plain_search(docs, [(r[0], r[1]) for r in items.collect()], 10)
    assert [r[2] for r in sorted(x for x in got if x[0] == 1)][-1] is not None
    assert lexical.search(none, items).count() == 0 and lexical.search(odd, items.limit(0)).count() == 0


# 4, 6, 8. Sizes and orders that must not matter

def test_mixing_agrees_on_reruns(spark):
    """Repeated ids of other sizes, null ids, equal texts: read forwards, backwards and in other partitions."""
    rows = [(i % 7 if i % 5 else None, " ".join(["w"] * (i * 37 % 50 + 1)), None, f"s{i % 3}") for i in range(120)]
    took = []
    for order in (rows, rows[::-1], sorted(rows, key=str)):
        docs = documents(spark, order).repartition(len(took) + 1)
        took.append(sorted(map(str, mixing.mix(docs).select("doc_id", "source", "size", "target", "taken").collect())))
    assert took[0] == took[1] == took[2]


def test_a_repeated_id_trains_each_text_under_its_own_language(spark):
    rows = [(k, "the quick brown fox and the dog" if k % 2 else "el zorro y los perros que corren", "en" if k % 2 else "es", "a")
            for k in range(40)]
    rows += [(50, "the dog and the fox", "en", "a"), (50, "los perros y el zorro", "es", "a")]
    docs = documents(spark, rows)
    model = language.fit(docs, F.lit(True))
    got = {(r["doc_id"], r["lang_pred"]) for r in language.predicted(docs, model).collect()}
    assert got == {(i, g) for i, _, g, _ in rows}


def test_centroids_against_brute_force(spark):
    """Document frequencies over all training rows, and the nearest centroid by cosine."""
    random = np.random.default_rng(5)
    words = {"x": ["alpha", "beta", "gama"], "y": ["uno", "dos", "tres"]}
    rows = [(k, " ".join(random.choice(words[g], 12)), g, "a") for k in range(60) for g in ["xy"[k % 2]]]
    docs = documents(spark, rows)
    model = language.fit(docs, F.col("doc_id") < 50, per_language=5)
    counts = np.array([language.counts_of(t) > 0 for i, t, _, _ in rows if i < 50])
    assert np.allclose(model.inverse, np.log(51 / (1 + counts.sum(axis=0))) + 0.1)
    for r in language.predicted(docs, model).collect():
        text = next(t for i, t, _, _ in rows if i == r["doc_id"])
        cosine = model.middles @ language.vector_of(language.counts_of(text), model.inverse)
        assert r["lang_pred"] == model.langs[int(cosine.argmax())] and r["score"] == pytest.approx(cosine.max())


@pytest.mark.parametrize("number", [300, 4_000])
def test_neighbour_recall_at_the_registered_share(spark, number):
    """The forest's own share, no switch by size; leaves so small that even a small table has several."""
    random = np.random.default_rng(number)
    vectors = random.normal(size=(number, 24))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    hits = 0
    asked = range(0, number, 50)
    got = defaultdict(list)
    found = neighbours.nearest(frame, F.col("vec_id") % 50 == 0, leaf_rows=64, block_queries=10)
    for r in found.collect():
        got[r["query_id"]].append(r["vec_id"])
    for q in asked:
        near = [i for i in np.argsort(-(vectors @ vectors[q]), kind="stable") if i != q][:20]
        hits += len(set(got[q]) & set(near))
    assert hits >= 0.9 * 20 * len(asked)


def test_neighbour_candidates_do_not_grow_with_the_leaves(spark):
    """Four times the vectors and leaves: a bounded number of rows a query, and the result of scoring all leaves that it takes."""
    random, rows = np.random.default_rng(3), []
    for number, sample, held in ((1_500, 200, 1_000_000), (6_000, 200, 500), (6_000, 6_000, 500)):
        vectors = random.normal(size=(number, 16))
        vectors[number - 30:] = np.round(vectors[number - 30:])  # equal scores
        points, queries = vectors[:sample], range(0, number, number // 30)
        levels = int(np.log2(number / 47))
        forest = neighbours.grow(points, np.sqrt((vectors ** 2).sum(axis=1).max()), levels, 4)
        frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "class long, embedding array<double>")
        asked = frame.filter(F.col("class").isin(*queries)).withColumnRenamed("class", "ask")
        found = neighbours.candidates(frame, asked, forest, points, 1.1, 20, 2, held).collect()
        rows.append(len(found) / len(queries))
        leaf = forest.leaves(vectors)
        for q in queries:
            taken = set(forest.probes(vectors[q], 1.1))
            held_by = [i for i in range(number) if any((t, leaf[i, t]) in taken for t in range(4))]
            want = sorted(held_by, key=lambda i: (-round(float(vectors[i] @ vectors[q]), 9), i))[:21]
            got = {(r["class"], round(r["score"], 9)) for r in found if r["ask"] == q}
            assert [i for i, _ in sorted(got, key=lambda x: (-x[1], x[0]))[:21]] == want
    # At most 21 for each of 4 cells of 4 trees; where the sample tells all, 21 for each tree.
    assert max(rows) <= 4 * 4 * 21 and rows[2] < 4 * 22


# 1. Line templates

def plain_templates(docs, min_docs=10, depth=3, alike=0.6):
    """The tree as nested loops: (doc_id, number of dropped lines, number of their templates)."""
    def masked(line):
        plain = re.sub("[\t\r\x0b\f ]+", " ", line.strip(" \t\r\x0b\x0c"))
        return " ".join(re.sub("^[^0-9]*[0-9].*$", "<*>", t) for t in plain.split(" "))

    lines = [(d, m) for d, t in docs if t is not None for m in {masked(x) for x in t.split("\n")} - {""}]
    count, leaves = Counter(m for _, m in lines), defaultdict(set)
    for m in count:
        leaves[m.count(" "), tuple(m.split(" ")[:depth])].add(m)
    template = {}
    for own in leaves.values():
        if sum(count[m] for m in own) < min_docs:
            continue
        made = []  # each: its tokens, its lines
        for m in sorted(own, key=lambda m: (-count[m], m)):
            tokens, best = m.split(" "), (alike - 1e-9, None)
            for t in made:
                same = sum(a == b != "<*>" for a, b in zip(t[0], tokens, strict=True))
                fit = same / max(1, sum(x != "<*>" for x in t[0]), sum(x != "<*>" for x in tokens))
                if fit > best[0] or best[1] is None and fit >= best[0]:
                    best = (fit, t)
            if best[1] is None:
                made.append([tokens, [m]])
            else:
                best[1][0] = [a if a == b else "<*>" for a, b in zip(best[1][0], tokens, strict=True)]
                best[1][1].append(m)
        for tokens, held in made:
            template |= {m: (len(tokens), tokens[0], " ".join(tokens)) for m in held}
    owners, seen = defaultdict(set), defaultdict(set)
    for d, m in lines:
        seen[m].add(d)
        owners[template.get(m)].add(d)
    out = defaultdict(lambda: (set(), set()))
    for d, m in lines:
        name = template.get(m) if m in template and len(owners[template[m]]) >= min_docs else m if len(seen[m]) >= 2 else None
        if name is not None:
            out[d][0].add(m)
            out[d][1].add(name)
    return {(d, len(a), len(b)) for d, (a, b) in out.items()}


def test_line_templates_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(10_000 + k, f"Page {k} of the great book of {['tales', 'songs', 'maps'][k % 3]} {k}th ed.\n"
                                               + ("very " * 9_000) + f"long line {k}") for k in range(14)], docs.schema)
    docs = docs.unionByName(more)
    want = plain_templates([tuple(r) for r in docs.collect()])
    got = {(r["doc_id"], r["dropped"], r["templates"]) for r in templates.report(templates.recurring(docs)).collect()}
    assert got == want and len([x for x in got if x[0] >= 10_000]) == 14


# 9. Quality

def plain_posterior(texts, rounds=100):
    """Expectation-maximisation over documents one by one: probability of good for each pattern of votes."""
    patterns = [p for p in (quality.pattern_of(quality._raw(t)) for t in texts) if p.strip("0")]
    good = {p: 0.1 if "-" in p else 0.95 for p in patterns}
    for _ in range(rounds):
        share = sum(good[p] for p in patterns) / len(patterns)
        tables = []
        for k in range(8):
            held = {True: dict.fromkeys("0+-", 0.5), False: dict.fromkeys("0+-", 0.5)}
            for p in patterns:
                held[True][p[k]] += good[p]
                held[False][p[k]] += 1 - good[p]
            tables.append({s: {v: n / sum(t.values()) for v, n in t.items()} for s, t in held.items()})
        after = {}
        for p in good:
            sides = [math.log(min(1, max(1e-6, x))) + sum(math.log(tables[k][s][p[k]]) for k in range(8))
                     for s, x in ((False, 1 - share), (True, share))]
            after[p] = 1 / (1 + math.exp(min(50, max(-50, sides[0] - sides[1]))))
        good = after
    return good


def test_quality_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts = dict(docs.collect())
    model, plain = quality.fit(docs), plain_posterior(texts.values())
    assert model.posterior.keys() == plain.keys()
    assert [model.posterior[p] for p in sorted(plain)] == pytest.approx([plain[p] for p in sorted(plain)], abs=1e-6)
    for r in quality.scored(docs).collect():
        raw = quality._raw(texts[r["doc_id"]])
        if quality.scorable(raw):
            want = 1 / (1 + math.exp(-(float(quality.features(raw) @ model.weights) + float(model.bias))))
        else:
            pattern = quality.pattern_of(raw)
            want = plain[pattern] if "-" in pattern else 1.0
        assert r["score"] == pytest.approx(want, abs=1e-4) and r["keep"] == (r["score"] >= 0.5)

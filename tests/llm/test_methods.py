"""The methods by name (automaton, models, field, passages) and rows without a good key, against brute force."""

import collections
import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_dealt import DOC, brute_fingerprint, docs_of, prose
from wickline.llm import bpe, decontam, lines, pii, sharding, simhash, toxicity, urls, warc
from wickline.llm.common import fresh_path, pieces

# ---------------------------------------------------------------- automaton


def merged(word, merges):
    """Plain BPE: the merge of lowest rank, everywhere from the left, until none applies."""
    out = [bytes([b]) for b in word]
    for u, v in merges:
        i = 0
        while i < len(out) - 1:
            if (out[i], out[i + 1]) == (u, v):
                out[i : i + 2] = [u + v]
            i += 1
    return out


@pytest.mark.parametrize("seed", range(12))
def test_automaton_accepts_what_the_merges_produce(seed):
    """Small vocabularies: every word has the plain encoding, and no other token sequence is accepted."""
    r = random.Random(seed)
    alphabet = b"ab" if seed % 2 else b"abc"
    vocabulary, merges = [bytes([c]) for c in alphabet], []
    while len(merges) < 9:
        u, v = r.choice(vocabulary), r.choice(vocabulary)
        if u + v not in vocabulary:
            vocabulary.append(u + v)
            merges.append((u, v))
    ids = {b: i for i, b in enumerate(vocabulary)}
    tables = {"label": dict(enumerate(vocabulary)), "merges": [(ids[u], ids[v], ids[u + v]) for u, v in merges], "special": {}}
    automaton = bpe.Automaton(tables)
    assert 1 < automaton.states <= 1 + len(merges)
    codec = bpe.Codec(automaton.table() | tables)
    reached = {t for t in ids.values() if automaton.target[t] >= 0}
    for n in range(1, 8):
        for word in map(bytes, itertools.product(alphabet, repeat=n)):
            want = [ids[t] for t in merged(word, merges)]
            assert codec.walk(word) == want and set(want) <= reached
            if n < 6:
                accepted = []
                for cuts in itertools.product((False, True), repeat=n - 1):
                    ends = [i + 1 for i, c in enumerate(cuts) if c] + [n]
                    path = [ids.get(word[a:b]) for a, b in zip([0, *ends], ends)]
                    state = 0
                    for t in path:
                        state = int(automaton.target[t]) if state is not None and t in reached and automaton.has(state, t) else None
                    if state is not None:
                        accepted.append(path)
                assert accepted == [want]


def test_codec_in_one_pass_and_bounded_words(spark, monkeypatch):
    from tokenizers import Tokenizer

    from wickline.llm.queries import default_vocabulary

    path = default_vocabulary()
    rows = [(1, prose(400, 3)), (None, "x" * 70 + " " + prose(30, 5)), (1, prose(400, 3)), (2, None), (3, "🙂 e\u0301"), (4, "ab " * 50000)]
    out = bpe.code(docs_of(spark, rows).drop("ids"), path, drop_text=True).collect()
    own = Tokenizer.from_file(path)
    assert sorted(str(list(x.ids)) for x in out) == sorted(str(own.encode(t or "", add_special_tokens=False).ids) for _, t in rows)
    assert sorted(x.decoded for x in out) == sorted(t or "" for _, t in rows) and "text" not in out[0]
    monkeypatch.setattr(bpe, "CACHE_WORDS", 7)
    codec = bpe.Codec(bpe.compiled(path))
    text = prose(900, 8)
    assert codec.encode(text) == own.encode(text, add_special_tokens=False).ids and len(codec.words) <= 7 >= len(codec.older)


# ---------------------------------------------------------------- toxicity


def plain_models(texts, corpus):
    """Both models by their definition, over labelled texts (y, text)."""
    n = collections.Counter(w for t in corpus for w in toxicity.words(t))
    places = sum(n.values()) + len(n) + 1
    S = lambda w: (n[w] + 1) / places
    tri = {(y, *g) for y, t in texts for w in [toxicity.words(t)] for g in zip(["\n", "\n", *w], ["\n", *w], w)}
    c = {y: collections.Counter((h, w) for k, _, h, w in tri if k == y) for y in (1, 0)}
    k = {y: collections.Counter(w for h, w in c[y]) for y in (1, 0)}
    t = {y: sum(k[y].values()) for y in (1, 0)}
    g2 = lambda a, b, s: 2 * sum(x * math.log(x / e) for x, e in ((a, (a + b) * s), (b, (a + b) * (1 - s))) if x)
    share = t[1] / (t[1] + t[0])
    own = set()
    for w in n:
        a, b = k[1][w], k[0][w]
        odds = (a + 0.5) / (t[1] + 0.5) / ((b + 0.5) / (t[0] + 0.5))
        if g2(a, b, share) >= toxicity.MIN_G2 and (odds >= toxicity.MIN_RATIO or odds <= 1 / toxicity.MIN_RATIO):
            own.add(w)
    d1 = {y: {w: min(k[y][w], toxicity.DISCOUNT) if w in own else k[y][w] for w in n} for y in (1, 0)}
    P1 = lambda y, w: (k[y][w] - d1[y].get(w, 0)) / t[y] + sum(d1[y].values()) / t[y] * S(w)
    pairs = set()
    for h, w in set(c[1]) | set(c[0]):
        a, b = c[1][h, w], c[0][h, w]
        e = P1(1, w) * t[1] / (P1(1, w) * t[1] + P1(0, w) * t[0]) if w in own else share
        r = (a + 0.5) / (b + 0.5) / (e / (1 - e))
        if g2(a, b, e) >= toxicity.MIN_G2 and (r >= toxicity.MIN_RATIO or r <= 1 / toxicity.MIN_RATIO):
            pairs.add((h, w))

    def P2(y, h, w):
        total = sum(v for (a, _), v in c[y].items() if a == h)
        if not total:
            return P1(y, w)
        left = lambda p: min(c[y][p], toxicity.DISCOUNT) if p in pairs else c[y][p]
        return (c[y][h, w] - left((h, w))) / total + sum(left(p) for p in c[y] if p[0] == h) / total * P1(y, w)

    return n, S, P2, own, pairs


def test_both_models_against_their_definition(spark):
    r = random.Random(9)
    small = [f"w{i}" for i in range(12)]
    rows, marks = [], []
    for i in range(160):
        y = i % 2
        w = [r.choice(small) for _ in range(25)]
        for _ in range(4):
            at = r.randint(0, len(w))
            w[at:at] = r.choice((["vile"], ["w1", "scum"])) if y else r.choice((["nice"], ["w2", "day"]))
        rows.append((i, " ".join(w)))
        marks.append((i, y))
    rows.append((500, "only the corpus knows these words"))
    df = docs_of(spark, [(i, t.replace("w", "q").translate(str.maketrans("0123456789", "abcdefghij"))) for i, t in rows])
    model = toxicity.fit(df, spark.createDataFrame(marks, "doc_id long, toxic int"))
    import zlib

    text = {x.doc_id: x.text for x in df.collect()}
    used = [(y, text[i]) for i, y in marks if zlib.crc32(str(i).encode()) % 3 == 0]
    n, S, P2, own, pairs = plain_models(used, text.values())
    assert set(model["one"]) == own and set(model["two"]) == pairs and own and pairs
    for h in ["\n", "unheard", *n][:12] + [h for h, _ in pairs]:
        for i, y in enumerate((1, 0)):
            assert sum(toxicity.relative(model, h, w)[i] * S(w) for w in n) + toxicity.relative(model, h, "unseen word")[i] * S("unseen word") == pytest.approx(1)
            assert all(toxicity.relative(model, h, w)[i] * S(w) == pytest.approx(P2(y, h, w)) for w in n)
    for t in list(text.values())[:40]:
        w = toxicity.words(t)
        got = toxicity.log_likelihoods(model, w, {})
        for i, y in enumerate((1, 0)):
            assert got[i] == pytest.approx(sum(math.log(P2(y, h, x) / S(x)) for h, x in zip(["\n", *w], w)))
    seen = {x.doc_id: x.score for x in toxicity.score(df, model).collect()}
    for i, t in text.items():
        w = toxicity.words(t)
        d = sum(math.log(P2(1, h, x) / P2(0, h, x)) for h, x in zip(["\n", *w], w)) / len(w)
        assert seen[i] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, model["a"] + model["b"] * d)))))


def test_toxicity_without_ids_and_with_repeated_ones(spark):
    rows = [(i, ("vile scum " if i % 2 else "nice day ") * 3 + prose(30, i)) for i in range(300)]
    marks = [(i, i % 2) for i in range(300)] + [(None, 1)]
    more = [(None, rows[1][1]), (None, rows[2][1]), (7, prose(20, 900)), (7, rows[7][1]), (900, "vile scum " * 40000)]
    df = docs_of(spark, rows + more)
    model = toxicity.fit(df, spark.createDataFrame(marks, "doc_id long, toxic int"))
    out = toxicity.score(df, model).collect()
    assert len(out) == len(rows) + len(more)
    by_text = collections.defaultdict(set)
    for x in out:
        by_text[x.text].add(x.score)
    assert all(len(s) == 1 for s in by_text.values())


# ---------------------------------------------------------------- random field


def test_special_tokens_always_have_a_special_character():
    for cp in itertools.chain(range(0xD800), range(0xE000, 0x110000, 1)):
        c = chr(cp)
        if any(pii.shape(t) not in pii.PLAIN for t in pii._tokens(f"a{c}b")[0]):
            assert pii._SPECIAL.search(c), hex(cp)


def test_stretches_decode_like_the_whole_line():
    """Random weights: the tags of stretches are those of the line decoded at once with the fixed factor."""
    r = np.random.default_rng(3)
    k, pick = len(pii.TAGS), random.Random(4)
    field = pii.Field(r.normal(size=(5, len(pii.SHAPES), k)), r.normal(size=(2, k)), r.normal(size=(k, k)))
    finder = pii.Finder(field)
    for _ in range(40):
        line = " ".join(pick.choice(("word", "Word", "12", "@", "a1", "at", "(x)")) if pick.random() < 0.06 else "plain" for _ in range(pick.randint(1, 150)))
        toks, starts, ends = pii._tokens(line)
        ids = np.array([[pii.shape(t) for t in toks]])
        gaps = np.array([[0] + [int(a > b) for a, b in zip(starts[1:], ends)]])
        near = np.zeros(len(toks), bool)
        for lo, hi in pii.stretches(np.flatnonzero(~np.isin(ids[0], pii.PLAIN)), len(toks)):
            near[lo:hi] = True
        whole = field.emissions(ids, gaps)[0] + np.where(near[:, None] | (np.arange(k) == 0), 0.0, -1e9)
        best, back = whole[0] + np.where([t.startswith("I-") for t in pii.TAGS], -1e9, 0.0), []
        for i in range(1, len(toks)):
            step = best[:, None] + field.trans
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + whole[i]
        tags = [int(best.argmax())]
        for b in back[::-1]:
            tags.append(int(b[tags[-1]]))
        want, kind, start, end = [], "", 0, 0
        for t, a, b in zip([*tags[::-1], 0], [*starts, 0], [*ends, 0]):
            name = pii.TAGS[t]
            if kind and name != f"I-{kind}":
                want.append((kind, start, end))
                kind = ""
            if name.startswith("B-"):
                kind, start = name[2:], a
            end = b
        assert sorted(finder.added([line])[0]) == sorted(want)


def test_masking_is_linear_and_names_overlaps_once():
    assert pii.masked("ab cd ef", [("x", 0, 2, True), ("y", 1, 4, False), ("z", 6, 8, True)]) == "<x>d <z>"
    finder = pii.Finder(pii.default_field())
    text = ("a@b.example 10.0.0.1 " * 20000).strip()
    began = time.time()
    found = finder.spans([text])[0]
    assert len(found) == 40000 and pii.masked(text, found) == ("<email> <ip> " * 20000).strip() and time.time() - began < 30


# ---------------------------------------------------------------- passages


def test_every_word_of_a_repeated_passage_is_covered(spark):
    """Whatever 51 words in a row an earlier row has too are covered, and every row's words are those of the kept place."""
    r = random.Random(12)
    made = lambda n: [r.choice("abcdefghij") + r.choice("klmnopqrst") + str(r.randint(0, 999)) for _ in range(n)]
    pool = [made(r.randint(51, 160)) for _ in range(6)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(r.randint(1, 4)):
            w += made(r.randint(0, 60)) + (r.choice(pool) if r.random() < 0.6 else made(20))
        rows.append((i, " ".join(w)))
    rows += [(100, rows[3][1]), (None, rows[4][1]), (101, None)]
    text = dict(rows)
    got = collections.defaultdict(list)
    for x in lines.repeats(docs_of(spark, rows)).collect():
        got[x.doc_id].append((x.start, x.end))
        mine, kept = text[x.doc_id][x.start : x.end].split(), text[x.first_doc_id][x.first_start :].split()
        assert kept[: len(mine)] == mine
    seen = set()
    for i, t in sorted(rows, key=lambda x: (x[0] is None, x[0])):
        w = (t or "").split()
        at = list(itertools.accumulate([len(x) + 1 for x in w], initial=0))
        grams = [tuple(w[j : j + 51]) for j in range(len(w) - 50)]
        for j, g in enumerate(grams):
            if g in seen:
                assert all(any(a <= at[q] and at[q] + len(w[q]) <= b for a, b in got[i]) for q in range(j, j + 51)), (i, j)
        seen.update(grams)


def test_lines_are_linear():
    began = time.time()
    for text in ("." * 1_000_000, " " * 1_000_000, ". " * 500_000, " \n" * 500_000, "\n" * 1_000_000):
        for unit in lines.UNITS:
            lines.units(text, unit)
    assert time.time() - began < 20


# ---------------------------------------------------------------- rows without a good key


def test_remove_cuts_only_the_row_that_repeats(spark):
    a, b = prose(30, 1), prose(40, 2)
    rows = [(1, a), (5, b), (5, a), (None, b), (None, "else"), (None, None)]
    left = sorted(str((r.doc_id, r.text)) for r in lines.remove(docs_of(spark, rows)).collect())
    assert left == sorted(map(str, [(1, a), (5, b), (5, ""), (None, ""), (None, "else"), (None, None)]))


def test_keep_one_never_drops_a_text_for_its_id(spark):
    a, b, c = prose(60, 1), prose(60, 2), prose(60, 3)
    rows = [(None, a), (None, b), (7, b), (7, c), (7, c), (8, a), (None, c), (9, None), (None, "")]
    kept = sorted(str((r.doc_id, r.text)) for r in simhash.keep_one(docs_of(spark, rows)).collect())
    assert kept == sorted(map(str, [(8, a), (7, b), (7, c), (9, None)]))
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(docs_of(spark, rows)).collect()}
    fp = lambda t: simhash._signed(brute_fingerprint(t))
    assert got[None, fp(a)] == 8 and got[None, fp(b)] == 7 and got[None, fp("")] == 9
    assert simhash.near_duplicates(docs_of(spark, [(None, a)])).first().component_id is None


def test_decontamination_judges_rows(spark):
    item, other = prose(40, 1), prose(60, 2)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    words = item.split()
    rows = [(None, f"{other} {item}"), (None, other), (3, item), (3, other), (4, " ".join(words[:20])), (4, " ".join(words[20:])), (5, item), (5, item)]
    for limit in (100_000, 0):
        left = sorted(str((r.doc_id, r.text)) for r in decontam.remove(docs_of(spark, rows), bench, broadcast_rows=limit).collect())
        assert left == sorted(map(str, [(None, other), (3, other), *rows[4:6]]))
        assert sorted(str(r.doc_id) for r in decontam.matches(docs_of(spark, rows), bench, broadcast_rows=limit).collect()) == ["3", "5", "None"]


@pytest.mark.parametrize("limit", [100_000, 0])
def test_bytes_stay_even_without_good_ids(spark, limit):
    rows = [(i, prose(40 + i % 20, i)) for i in range(2000)] + [(None, prose(50, i)) for i in range(900)] + [(77, prose(55, 5))] * 900
    df = docs_of(spark, rows)
    recs = sharding.records(df, broadcast_rows=limit)
    stats = sharding.slot_stats(recs)
    placed = sharding.place(recs, sharding.rebalance(sharding.first_map(spark, 5), stats, 5), stats).collect()
    size, slots = collections.Counter(), collections.defaultdict(list)
    for r in placed:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(placed) == len(rows) and max(size.values()) < 1.02 * min(size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_warc_keeps_every_row(spark):
    pages = [(1, "a", "x" * 5000), (1, "b", "y" * 3000), (None, "c", "x" * 5000), (None, None, "z"), (None, "d", "z"), (2, "e", "y" * 3000), (2, "e", "y" * 3000), (3, "f", None), (None, "g", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = fresh_path(spark, "warc")
    warc.write_archives(df, path, records_per_file=3, chunk_bytes=100, segment_bytes=700)
    got = warc.read_archives(spark, path).collect()
    assert {r.status for r in got} == {"ok"} and len(got) == len(pages)
    key = lambda r: str((r.page and int(r.page), r.record_type, r.refers_to and int(r.refers_to), r.payload_bytes))
    want = [(1, "response", None, 5000), (1, "response", None, 3000), (None, "revisit", 1, 5000), (None, "response", None, 1), (None, "revisit", None, 1), (2, "revisit", 1, 3000), (2, "revisit", 1, 3000), (3, "response", None, 0), (None, "revisit", 3, 0)]
    assert sorted(map(key, got)) == sorted(map(str, want))


def test_long_addresses_are_linear(spark):
    long = "http://a.org/" + "xy" * 20000
    df = spark.createDataFrame([(1, long), (2, None), (None, long)] + [(10 + i, f"http://good{i}.com/ok") for i in range(9)] + [(30 + i, f"http://bad{i}.net/fr/") for i in range(9)], "page_id long, url string")
    began = time.time()
    assert urls.classify(df).count() == 21 and time.time() - began < 60


def brute_url_values(labelled, addresses, order=urls.ORDER):
    """Difference per character of each address by plain counting of (text, ok) pairs."""
    counts = {y: collections.Counter(s[e - k : e] for s, ok in labelled if ok == bool(y) for e in range(1, len(s) + 1) for k in range(1, min(e, order) + 1)) for y in (1, 0)}
    seen, n, t = set(counts[1]) | set(counts[0]), collections.Counter(), collections.Counter()
    for y in (1, 0):
        for g, c in counts[y].items():
            n[y, len(g), g[:-1]] += c
            t[y, len(g), g[:-1]] += 1

    def p(y, gram):
        low, at = 1 / urls.CHARS if len(gram) == 1 else p(y, gram[1:]), (y, len(gram), gram[:-1])
        return (max(counts[y][gram] - urls.DISCOUNT, 0) + urls.DISCOUNT * t[at] * low) / n[at] if n[at] else low

    out = {}
    for a in addresses:
        ends = [next((a[e - k : e] for k in range(min(e, order), 0, -1) if a[e - k : e] in seen), None) for e in range(1, len(a) + 1)]
        out[a] = sum(np.log(p(1, g) / p(0, g)) for g in ends if g) / max(len(a), 1)
    return out


def test_url_filter_learns_from_every_judged_address(spark):
    """The models hold all labelled addresses, the threshold comes from all accepted ones, each scored without its fold."""
    good, bad = [f"shop{i}.com/ok/{i * 37}" for i in range(50)], [f"spam{i}.net/fr/buy{i * 31}" for i in range(25)]
    free = [f"shop{i}.org/{x}/{i}" for i in range(12) for x in ("ok", "buy", "fr", "")] + [f"shop{i}.comm/ok/{i * 37}" for i in range(20, 30)] + ["\u00e9\U0001f600.org/x", "s", ""]
    df = spark.createDataFrame([(i, f"http://{a}") for i, a in enumerate(good + good[:9] + bad + free)] + [(None, None)], "page_id long, url string")
    got = {r.host + r.path: r for r in urls.classify(df).collect()}
    labelled = [(a, a in good) for a in good + bad]
    want = brute_url_values(labelled, free)
    assert all(got[a].rule is None and got[a].value == pytest.approx(want[a], abs=1e-12) for a in free)
    fold = F.pmod(F.xxhash64(F.lit("held"), F.regexp_extract("a", "^[^/]*", 0), F.regexp_extract("a", "/.*$", 0)), F.lit(urls.FOLDS))
    folds = {r.a: r.f for r in spark.createDataFrame([(a,) for a in good + bad], "a string").select("a", fold.alias("f")).collect()}
    assert len(set(folds[a] for a in good)) == urls.FOLDS
    held = sorted(brute_url_values([x for x in labelled if folds[x[0]] != folds[a]], [a])[a] for a in good)
    bar = held[int(49 * 0.05)]
    for a in free:
        assert got[a].verdict == ("allow" if want[a] >= bar else "block") or want[a] == pytest.approx(bar)
    assert {got[a].verdict for a in free} == {"allow", "block"}


def test_url_filter_has_no_cap_on_labelled_addresses(spark, monkeypatch):
    n, seen, train = 20_300, [], urls.train
    monkeypatch.setattr(urls, "train", lambda rows, *a, **b: (seen.append(rows.count()), train(rows, *a, **b))[1])
    df = spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("http://g.com/"), "id").alias("url"))
    df = df.union(spark.createDataFrame([(-1, "http://b.net/fr/1"), (-2, "http://c.org/")], "page_id long, url string"))
    assert urls.classify(df).count() == n + 2 and seen == [n + 1]


def test_url_windows_beyond_the_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([(f"h{i % 7}.com", f"/p{i * i}", i % 3 > 0) for i in range(60)], "host string, path string, ok boolean")
    model = urls.train(rows.select(F.concat("host", "path").alias("s"), "ok"))
    read = lambda: {(r.host, r.path): r.value for r in urls.differences(rows, model).collect()}
    want = read()
    monkeypatch.setattr(urls, "BROADCAST_ROWS", 40)
    assert len(want) == 60 and read() == pytest.approx(want, abs=1e-12)


def test_url_threshold_is_exact(spark):
    rng = np.random.default_rng(5)
    for values in (rng.normal(size=3001), np.repeat([1e-300, -2.0, 7.0], 9), np.exp(rng.normal(size=500) * 9), np.array([0.25]), np.array([])):
        got = urls.threshold(spark.createDataFrame([(float(v),) for v in values], "value double"), 0.95)
        assert got == (sorted(values)[int((len(values) - 1) * (1 - 0.95))] if len(values) else None)


def test_pieces_bound_rows_and_bytes():
    import pyarrow as pa

    col = pa.array(["a" * 10, None, "b" * 100, "c", "", "d" * 5] * 3)
    for part in (col, col.slice(5, 9), col.slice(0, 0)):
        found = list(pieces(part, rows=4, size=20))
        assert sum(n for _, n in found) == len(part) and [a for a, _ in found] == list(np.cumsum([0] + [n for _, n in found]))[:-1]
        assert all(n <= 4 and (n == 1 or sum(len(x or "") for x in part.slice(a, n).to_pylist()) <= 20) for a, n in found)


def test_clashing_names_everywhere(spark):
    """Columns named like those that operators make pass through or are replaced; nothing crashes."""
    df = docs_of(spark, [(1, prose(60, 1)), (2, prose(60, 2))]).withColumns({c: df_lit for c, df_lit in _clashes().items()})
    assert set(df.columns) <= set(simhash.keep_one(df).columns) and set(df.columns) <= set(lines.remove(df).columns)
    assert set(df.columns) <= set(pii.redact(df).columns) and DOC
    assert sharding.records(df).columns == ["doc_id", "size", "text_crc32", "virtual_slot"]


def _clashes():
    from pyspark.sql import functions as F

    return {c: F.lit(c) for c in ("id", "key", "t", "h", "n", "fp", "start", "item", "row", "size", "shard")}

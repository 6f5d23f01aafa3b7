"""Every registered query of the corpus operators, on the smallest tables: against its SQL, or against plain code over the same tables."""

import base64
import collections
import glob
import hashlib
import os
import re
import zlib

import duckdb
import pytest

import __spark_entry__
from tests.llm.test_dealt import brute_components, brute_fingerprint
from tests.test_queries import rows as rounded
from wickline.llm import queries, toxicity, urls
from wickline.llm.common import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
KNOWN = __spark_entry__.queries()


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}


@pytest.fixture(scope="module")
def got(spark):
    cache = {}

    def run(name):
        if name not in cache:
            cache[name] = KNOWN[name](spark, SF).collect()
        return cache[name]

    return run


def test_all_ten_are_registered():
    assert [sum(n.startswith(f"op{i}_") for n in KNOWN) for i in range(1, 11)] == [1] * 10 and "pipeline" in KNOWN


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_its_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    mine, theirs = KNOWN[name](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns) and rounded(mine) == rounded(theirs)


def test_op1(got, docs):
    prints = {i: brute_fingerprint(t) for i, t in docs.items()}
    roots, low = brute_components(list(prints.values())), {}
    for i in sorted(prints):
        low.setdefault(roots[prints[i]], i)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got("op1_simhash_near_dedup")} == {(i, format(f, "016x"), low[roots[f]]) for i, f in prints.items()}


def test_op2(got, docs):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(queries.default_vocabulary())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for i, t in docs.items():
        ids = own.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), sha(",".join(map(str, ids))), sha(own.decode(ids, skip_special_tokens=False))))
    assert {tuple(r)[:4] for r in got("op2_bpe_codec")} == want


def test_op3(got, docs):
    rows = got("op3_toxicity")
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= toxicity.THRESHOLD)


def test_op4(got, docs):
    rows = got("op4_virtual_slots")
    assert len(rows) == len(docs)
    size, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        data = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None) and 0 <= r.shard < 40
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r.size for r in rows)
    assert max(size.values()) - min(size.values()) <= largest  # no slot can be dealt finer than its largest row


def test_op5(spark, got):
    pages = {r.page_id: r.url for r in table(spark, SF, "pages").collect()}
    for r in got("op5_url_filter"):
        rest = (pages[r.page_id] or "").partition("://")[2]
        m = re.match(r"([^/?#]*)([^?#]*)", rest)
        host, path = re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]
        fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None)
        assert r.verdict == max(fits)[2] if fits else r.verdict in ("allow", "block")
    assert len(got("op5_url_filter")) == len(pages)


def test_op6(got, docs):
    """Repeated paragraphs are found as they are, and whatever 51 words in a row an earlier document has are covered."""
    rows = got("op6_line_dedup")
    spans = collections.defaultdict(list)
    for r in rows:
        spans[r.doc_id].append((r.start, r.end))
    bare = lambda w: w.lower().strip(" \t.,;:!?\"'()[]{}<>|-*#$%&")
    seen = set()
    for i in sorted(docs):
        words = [(m.start(), m.end(), bare(m.group())) for m in re.finditer(r"\S+", docs[i] or "") if bare(m.group())]
        grams = [tuple(w for _, _, w in words[k : k + 51]) for k in range(len(words) - 50)]
        for k, g in enumerate(grams):
            if g in seen:
                assert all(any(a <= s < b for a, b in spans[i]) for s, _, _ in words[k : k + 51]), (i, k)
        seen.update(grams)
    for r in rows:
        assert (r.first_doc_id, r.first_start) < (r.doc_id, r.start)


def test_op9(got, docs):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def ok(kind, found):
        digits = re.sub("[^0-9]", "", found)
        if kind == "ip":
            return all(int(p) <= 255 for p in found.split("."))
        if kind == "card":
            return 13 <= len(digits) <= 19 and sum(sum(divmod(int(x) * (1 + k % 2), 10)) for k, x in enumerate(digits[::-1])) % 10 == 0
        return kind != "phone" or 9 <= len(digits) <= 15

    for r in got("op9_pii_spans"):
        base = [(k, m.start(), m.end()) for k, p in kinds.items() for m in re.finditer(p, docs[r.doc_id] or "") if ok(k, m.group())]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for x, _, _ in base) for k in kinds)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and set(text.split(",")) - {""} <= set(r.spans.split(","))


def test_op10(spark, got):
    first = {}
    pages = sorted((r.page_id, r.html or "") for r in table(spark, SF, "pages").collect())
    want = set()
    for i, h in pages:
        f = first.setdefault(h, i)
        want.add((i, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if f == i else "revisit", None if f == i else f))
    assert {tuple(r)[:5] for r in got("op10_warc_segments")} == want

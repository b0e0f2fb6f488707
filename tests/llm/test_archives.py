"""Merkle manifests, web archives and spelling variants against brute force."""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from headway.llm import merkle, warc
from headway.llm.merkle import authentication_paths, block_root, folded, height, merkle_manifest, parent, proofs
from headway.llm.spelling import op13_spelling_variants, spelling_variants, word_counts

DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree string, at long, leaf string"


# Merkle manifest


def level_by_level(nodes, arity):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([parent(out[-1][k : k + arity]) for k in range(0, len(out[-1]), arity)])
    return out


def proof_of(levels, at, arity):
    sides = []
    for nodes in levels[:-1]:
        run = nodes[at // arity * arity : (at // arity + 1) * arity]
        sides.append({"left": "".join(run[: at % arity]), "right": "".join(run[at % arity + 1 :])})
        at //= arity
    return sides


@pytest.mark.parametrize("arity", [2, 3, 16])
def test_a_walk_gives_each_path_and_holds_little(arity):
    for n in (1, 2, 3, arity, arity + 1, arity**2, arity**2 + 1, 3 * arity**2 - 1):
        leaves = [hashlib.sha256(bytes([k % 256, k // 256])).hexdigest() for k in range(n)]
        levels = level_by_level(leaves, arity)
        assert block_root(leaves, height(n, arity), arity) == levels[-1][0]
        asked = []
        walk = authentication_paths(lambda k: asked.append(k) or leaves[k], n, height(n, arity), arity)  # noqa: B023
        for at, path in enumerate(walk):
            got = [{"left": "".join(run[:k]), "right": "".join(run[k + 1 :])} for run, k in path]
            assert got == proof_of(levels, at, arity) and folded(leaves[at], got) == levels[-1][0]
            assert all(len(run) <= arity for run, _ in path)
        assert len(asked) <= n * height(n, arity)  # each leaf at most once for each level


def wanted_manifest(rows, arity):
    """{row number: (leaf, subroot, root, proof)}, by brute force."""
    leaf = lambda r: hashlib.sha256(b"".join(b"-" if v is None else b"%d:" % len(str(v).encode()) + str(v).encode() for v in (r[0], r[1], r[2], r[3], r[4]))).hexdigest()
    sources = defaultdict(list)
    for k, r in enumerate(rows):
        sources[r[1]].append(k)
    trees = {}
    for s, own in sources.items():
        own.sort(key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, leaf(rows[k])))
        trees[s] = level_by_level([leaf(rows[k]) for k in own], arity)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    top, out = level_by_level([trees[s][-1][0] for s in order], arity), []
    for s in order:
        for at, k in enumerate(sources[s]):
            path = proof_of(trees[s], at, arity) + proof_of(top, order.index(s), arity)
            proof = hashlib.sha256("".join(p["left"] + p["right"] for p in path).encode()).hexdigest()
            out.append((rows[k][0], leaf(rows[k]), trees[s][-1][0], top[-1][0], proof))
    return out


@pytest.mark.parametrize(("arity", "levels"), [(2, 1), (3, 2), (16, 3)])
def test_manifest_against_brute_force(spark, arity, levels):
    rng = random.Random(arity)
    rows = [(k, f"s{min(9, rng.randrange(30))}", rng.choice(["en", None]), k * 7, rng.choice(["a B", "c", "", None, "ü" * 9])) for k in range(150)]
    rows += [(5, "s1", "en", None, "again"), (5, "s1", "en", None, "again"), (None, "s1", "en", 1, "x"), (None, None, None, None, None), (900, None, "en", 1, "y"), (901, "", "en", 1, "y"), (902, "alone", "en", 1, "L" * 300_000)]
    docs = spark.createDataFrame([(*r, "t", 1, "l") for r in rows], DOCS)
    got = proofs(merkle_manifest(docs, claimed={"text": F.lower("text")}, arity=arity, levels=levels), paths=True).collect()
    assert sorted(map(str, ((r.id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in got))) == sorted(map(str, wanted_manifest(rows, arity)))
    for r in got:
        path = [p.asDict() for p in r.path]
        assert folded(r.leaf, path) == r.root and folded(r.claim, path) == r.folded_root
        assert (r.folded_root == r.root) == (r.claim == r.leaf)
    assert {r.id for r in got if r.claim != r.leaf} == {r[0] for r in rows if (r[4] or "").lower() != (r[4] or "")}
    assert proofs(merkle_manifest(docs.limit(0))).count() == 0


def test_a_lone_row_is_its_own_root(spark):
    docs = spark.createDataFrame([(1, "s", "en", 1, "a", "t", 1, "l")], DOCS)
    (r,) = proofs(merkle_manifest(docs)).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof_sha256 == hashlib.sha256(b"").hexdigest()


def test_tampered_rows_are_told(spark, tmp_path):
    rows = [(k, "s", "en", 1, "Text" if k % 2 else "text") for k in range(300)] + [(None, "s", "en", 1, "Text")]
    spark.createDataFrame([(*r, "t", 1, "l") for r in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    for r in merkle.op11_merkle_manifest(spark, str(tmp_path)).collect():
        assert r.verified == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 != 0 or r.doc_id % 2 == 0)


# Web archives

PAGES = [
    (1, "http://a.example/x", "<p>same</p>"), (2, "http://a.example/y", "<p>same</p>"), (7, "http://b.example/", "<p>same</p>"), (3, None, None), (4, "", ""), (5, "http://c d.example/\n", "WARC/1.1\r\n\r\n\r\n filedesc://x"),
    (6, "http://e.example/", "ü" * 70_000), (8, "http://f.example/", "\n\n1 2 3\n"), (8, "http://f.example/", "\n\n1 2 3\n"), (None, "http://g.example/", "no id"), (None, "http://g.example/", "<p>same</p>"), (9, "-", "http HTTP/1.1 200"), (10, "http://h", "HTTP/1.1 200 OK\r\n\r\nx"),
]
PAGE = "page_id long, url string, html string, path string, offset long, content string"


def pages_frame(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, "c") for r in rows], PAGE)


def test_archives_come_back_as_they_went(spark, tmp_path):
    pages = pages_frame(spark, PAGES).coalesce(2)
    arc, out = f"{tmp_path}/arc", f"{tmp_path}/warc"
    warc.write_arc(pages, arc, archive_bytes=400)
    files = [gzip.decompress(f.read_bytes()) for f in (tmp_path / "arc").glob("*.gz")]
    assert {b.split(b"\n")[1][:1] for b in files} == {b"1", b"2"}  # both versions
    warc.arc_to_warc(spark, arc, out)
    got = warc.resolved(warc.warc_records(spark, out)).collect()
    held = {}
    for page, _, html in PAGES:
        key = (html or "").encode()
        held[key] = max(held.get(key, -1), -1 if page is None else page)
    assert sorted(r.page_id if r.page_id is not None else -1 for r in got) == sorted(-1 if p is None else p for p, _, _ in PAGES)
    seen = Counter()
    for r in got:
        same = [key for key in held if base64.b32encode(hashlib.sha1(key).digest()).decode() == r.payload_digest]
        assert len(same) == 1 and r.payload_bytes == len(same[0])
        seen[same[0], r.record_type] += 1
        if r.record_type == "response":
            assert r.refers_to is None and (-1 if r.page_id is None else r.page_id) == held[same[0]]
        else:
            assert r.refers_to == held[same[0]] and r.refers_to_id in {x.record_id for x in got if x.record_type == "response"}
    n = Counter((h or "").encode() for _, _, h in PAGES)
    assert all(seen[key, "response"] == 1 and seen[key, "revisit"] == n[key] - 1 for key in held)
    assert len({r.record_id for r in got}) == len(PAGES)
    urls = {r.page_id: r.url for r in got}
    assert urls[5] == "http://c%20d.example/%0A" and urls[3] is urls[4] is None and urls[9] is None and urls[6] == "http://e.example/"
    assert {r.date for r in got if r.page_id == 7} == {"2001-01-01T00:00:07Z"}


def test_small_payloads_are_no_revisits_and_empty_tables_give_no_rows(spark, tmp_path):
    pages = pages_frame(spark, PAGES)
    warc.write_arc(pages, f"{tmp_path}/a")
    warc.arc_to_warc(spark, f"{tmp_path}/a", f"{tmp_path}/w", least_bytes=11)
    types = Counter((r.record_type, r.payload_bytes) for r in warc.resolved(warc.warc_records(spark, f"{tmp_path}/w")).collect())
    assert types["revisit", 11] == 3 and types["response", 0] == 2 and types["response", 8] == 2
    warc.write_arc(pages.limit(0), f"{tmp_path}/e")
    warc.arc_to_warc(spark, f"{tmp_path}/e", f"{tmp_path}/f")
    assert warc.resolved(warc.warc_records(spark, f"{tmp_path}/f")).count() == 0


def test_foreign_archives(spark, tmp_path):
    """Records that are no HTTP, a field order of its own, lengths that hold what looks like records; and archives that break off."""
    page = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\nhttp://fake.example/ 1.2.3.4 19990101000000 text/html 5\nhello"
    block = b"1 0 Someone\nURL IP-address Archive-date Content-type Archive-length\n"
    data = b"filedesc://old.arc 0.0.0.0 19970203040506 text/plain %d\n" % len(block) + block + b"\n"
    data += b"http://old.example/ 9.8.7.6 19970203040507 text/html %d\n" % len(page) + page + b"\n"
    data += b"dns:old.example 9.8.7.6 19970203040508 text/dns 3\nA 1\n"
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "old.arc").write_bytes(data)
    warc.arc_to_warc(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    got = {r.url: (r.record_type, r.date, r.payload_bytes) for r in warc.warc_records(spark, f"{tmp_path}/warc").collect()}
    assert got == {"http://old.example/": ("response", "1997-02-03T04:05:07Z", len(page) - 30), "dns:old.example": ("resource", "1997-02-03T04:05:08Z", 3)}
    (out,) = (gzip.decompress(f.read_bytes()) for f in (tmp_path / "warc").glob("*.gz"))
    assert re.search(rb"WARC-Type: warcinfo\r\n", out) and b"WARC-IP-Address: 9.8.7.6\r\n" in out and out.endswith(b"A 1\r\n\r\n")
    for broken in (data[:-3], data.replace(b" 9.8.7.6 ", b" "), data.replace(b"19970203040507", b"1997"), b"http://x 1 2 3 0\n"):
        with pytest.raises(warc.ArchiveError):
            warc._converted("x", broken, {})
    with pytest.raises(warc.ArchiveError):
        list(warc.parse_warc(out.replace(b"Content-Length: 3\r\n", b"Content-Length: 2\r\n")))


# Spelling variants


def variants_of(counts, least, ratio):
    """By deletion neighbours, for comparison."""
    n = {w: c for w, c in counts.items() if c >= least and len(w) > 1}
    gaps = defaultdict(set)
    for w in n:
        for k in range(len(w)):
            gaps[k, w[:k] + w[k + 1 :]].add(w)
    near = defaultdict(set)
    for (_, rest), own in gaps.items():
        for a, b in itertools.permutations(own, 2):
            near[a].add(b)
        if rest in n:
            for a in own:
                near[a].add(rest)
                near[rest].add(a)
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= ratio * n[w]:
                form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


@pytest.mark.parametrize(("shard", "chunk"), [(1 << 18, 1 << 20), (40, 90)])
def test_near_words_against_brute_force(spark, shard, chunk):
    rng = random.Random(8)
    words = Counter({"".join(rng.choice("abü") for _ in range(rng.randint(2, 7))): rng.choice([1, 2, 3, 30, 400, 5000]) for _ in range(400)})
    words |= Counter({"x" * 3000: 5, "x" * 3001: 60, "x" * 1500 + "y" + "x" * 1499: 2, "\U0001f600ab": 2, "\U0001f601ab": 20, "a": 50})
    rows = spark.createDataFrame([*words.items(), (None, 7)], "word string, n long").withColumn("length", F.lit("clash"))
    got = [tuple(r) for r in spelling_variants(rows, shard=shard, chunk=chunk).collect()]
    assert sorted(got) == variants_of(words, 2, 10)
    assert spelling_variants(rows.limit(0)).count() == 0


def test_words_are_counted_as_the_contract_says(spark, tmp_path):
    rng = random.Random(5)
    stock = ["Letters", "letters", "ÉCOLIÈRE", "straßenbahn", "kilometre", "kilometer", "a×b÷cdef", "short", "sixsix", "Ünïcödé"]
    texts = [" ".join(rng.choice(stock) + rng.choice(["", ".", "1", "_"]) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "letters letters"), (3, None), (4, ""), (3, texts[3]), (77, "letters " * 20_000)]
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    want = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                want[run] += 1
    assert {r.word: r.n for r in word_counts(docs, planted=31).collect()} == want
    assert len(want) > 12
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(tuple(r) for r in op13_spelling_variants(spark, str(tmp_path)).collect()) == variants_of(want, 2, 10)
    assert word_counts(docs.limit(0)).count() == 0

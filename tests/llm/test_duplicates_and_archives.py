"""SimHash, line and substring dedup, and WARC archives against brute force."""

import gzip
import hashlib
import random
from collections import defaultdict
from pathlib import Path

import pytest
import xxhash

from tidemark.llm import components, line_dedup, simhash, substring_dedup, warc

DOCS = "doc_id bigint, text string"


def union(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(7, 7), (200, -5), (200, -5)]
    want = union({x for e in edges for x in e}, edges)
    frame = spark.createDataFrame([*edges, (None, 3)], "a bigint, b bigint")
    got = {r.node: r.component for r in components.connected_components(frame).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {n: want[n] for n in linked}
    assert components.connected_components(frame.limit(0)).count() == 0


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_matches_brute_force(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghijk") * 2 for _ in range(90)) for _ in range(6)]
    texts = [None, "", " \t\n", "One", "two Words", "É\x85x\xa0y z"]
    for b in base:
        w = b.split()
        texts += [b, b.upper()] + [" ".join(w[:k] + ["new"] + w[k + 1 :]) for k in rng.sample(range(90), 12)]
    docs = spark.createDataFrame([*((i * 3 % 997, t) for i, t in enumerate(texts)), (0, None), (None, base[0])], DOCS).selectExpr("*", "1 as fp", "2 as id")
    fps = {i * 3 % 997: plain_fingerprint(t) for i, t in enumerate(texts)}
    ids = sorted(fps)
    edges = [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    want = union(ids, edges)
    assert len({*want.values()}) < len(ids) - 10
    for r in simhash.simhash_groups(docs).collect():
        key = r.doc_id if r.doc_id is not None else 6 * 3  # the text of the row without an id
        assert r.fingerprint == f"{fps[key]:016x}"
        assert r.component_id == want[key]
    # the row without an id leaves, as its group has ids; of the two empty rows of id 0 one stays
    assert sorted(r.doc_id for r in simhash.keep_first(docs).collect()) == sorted(set(want.values()))
    rows = [(None, base[0], "b"), (None, base[0], "a"), (None, base[0].upper(), "c"), (4, base[1], "x"), (4, base[1], "x"), (4, base[1], "y"), (9, base[1], "z"), (4, base[2], None)]
    left = simhash.keep_first(spark.createDataFrame(rows, DOCS + ", more string")).collect()
    assert sorted((str(r.doc_id), r.text.lower()) for r in left) == sorted([("4", base[1]), ("4", base[2]), ("None", base[0])])
    assert simhash.simhash_groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("segments", "max_bits", "crowd"), [(2, 2, 64), (2, 2, 4), (3, 2, 3), (4, 2, 8), (1, 1, 5), (5, 1, 2), (2, 3, 6), (7, 3, 64)])
def test_every_close_pair_is_linked(spark, segments, max_bits, crowd):
    rng = random.Random(segments * 10 + max_bits)
    centre = [rng.getrandbits(64) for _ in range(4)]
    fps = {c ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(5))}) for c in centre for _ in range(40)} | {0, 1, 1 << 63, 3 << 62}
    fps |= {centre[0] ^ k for k in range(50)}  # a crowd within a few bits
    signed = {f - (1 << 64) if f >> 63 else f for f in fps}
    frame = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    near = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= max_bits}
    rows = [tuple(r) for r in simhash.links(frame, segments, max_bits, crowd).collect()]
    assert len(rows) == len(near) and set(rows) == near
    assert simhash.links(frame.limit(0), segments, max_bits, crowd).count() == 0


def test_very_long_texts_and_lines(spark):
    long = " ".join(f"w{k}" for k in range(200_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, long + "\n" + long.replace("w7 ", "other ", 1) + "\nshort")], DOCS)
    got = {r.doc_id: r for r in simhash.simhash_groups(docs).collect()}
    assert {r.component_id for r in got.values()} == {1} and all(int(got[i].fingerprint, 16) == plain_fingerprint(t) for i, t in ((1, long), (2, long + " end")))
    lines = {r.doc_id: r.removed for r in line_dedup.dedup_lines(docs).collect()}
    assert lines == {1: [], 2: [0], 3: [0, 1]}


def plain_lines(docs, least=5):
    """Removed line numbers by document: an earlier line is equal, or one word edit away if both have ``least`` words."""
    seen, out = [], defaultdict(set)
    placed = sorted(((i, n, tuple(x.encode().lower().split())) for i, t in docs for n, x in enumerate((t or "").split("\n"))), key=lambda x: x[:2])
    for i, n, w in placed:
        if not w:
            continue
        cut = {w[:k] + w[k + 1 :] for k in range(len(w))}
        for j, m, v in seen:
            if (j, m) < (i, n):
                same_length = len(v) == len(w) and sum(a != b for a, b in zip(v, w, strict=True)) <= 1
                if v == w or min(len(v), len(w)) >= least and (same_length or v in cut or len(v) == len(w) + 1 and any(v[:k] + v[k + 1 :] == w for k in range(len(v)))):
                    out[i].add(n)
                    break
        seen.append((i, n, w))
    return out


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(11)
    base = [[rng.choice("abcdefgh") for _ in range(rng.choice([4, 5, 6, 9, 14]))] for _ in range(25)]

    def line():
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            k, op = rng.randrange(len(w)), rng.randrange(3)
            w[k : k + (op != 0)] = [] if op == 1 else [rng.choice("xyz")]
            w = w or ["q"]
        return rng.choice([" ", "\t", "  "]).join(w).upper() if rng.random() < 0.2 else " ".join(w)

    docs = [(i, "\n".join(line() if rng.random() < 0.9 else "" for _ in range(rng.randrange(9)))) for i in range(60)] + [(70, None), (71, ""), (72, "same old line of words\nsame old line of words")]
    frame = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 as removed", "2 as row", "3 as gone")
    want = plain_lines(docs)
    assert sum(map(len, want.values())) > 40
    for r in line_dedup.dedup_lines(frame).collect():
        assert set(r.removed) == want[r.doc_id], r.doc_id
        before = dict(docs)[r.doc_id]
        assert r.text == (None if before is None else "\n".join(x for n, x in enumerate(before.split("\n")) if n not in want[r.doc_id]))
        assert (r.row, r.gone) == (2, 3)
    twice = spark.createDataFrame([(1, "one two three four five"), (1, "one two three four five"), (None, "one two three four six")], DOCS)
    assert sorted((r.doc_id or 0, len(r.removed)) for r in line_dedup.dedup_lines(twice).collect()) == [(0, 0), (1, 1), (1, 1)]
    assert line_dedup.dedup_lines(frame.limit(0)).count() == 0


def test_compact_windows_tile_all_sequences():
    import numpy as np

    rng = np.random.default_rng(2)
    for values in (rng.integers(0, 9, 40), rng.permutation(60), np.zeros(30, dtype=int)):
        h, width = values.astype(np.uint64), 7
        found = substring_dedup.compact_windows(h, width)
        assert len(found) == len({tuple(f) for f in found.tolist()})
        for i in range(len(h)):
            for j in range(i + width - 1, len(h)):
                c = i + int(h[i : j + 1].argmin())
                assert sum(le <= i <= m <= j <= r for le, m, r in found) == 1
                assert any(le <= i and m == c and j <= r for le, m, r in found)


def test_repeated_passages_are_found(spark):
    rng = random.Random(4)
    prose = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, other = prose(60), prose(300)
    changed = list(passage)
    changed[30] = "changed"
    docs = {
        1: prose(80) + passage + prose(20), 2: prose(10) + passage + prose(200), 3: passage, 4: prose(5) + changed + prose(40), 5: prose(400), 6: prose(3),
        7: other, 8: other[:150] + ["one"] + other[151:], 9: passage[:40] + prose(100),
    }
    rows = [(k, " ".join(v)) for k, v in docs.items()] + [(20, None), (21, ""), (None, " ".join(passage)), (3, " ".join(passage))]
    frame = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as doc", "2 as spans")
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(frame, hashes=6).collect() if r.doc_id is not None}
    assert {k: r.component_id for k, r in got.items()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 7, 8: 7, 9: 9, 20: 20, 21: 21}
    assert got[2].spans == "10:70" and got[2].sources == [1] and got[3].spans == "0:60" and got[1].spans == "" and got[1].n_links == 3
    assert got[4].n_dup_words >= 50 and got[8].n_dup_words >= 290
    assert substring_dedup.substring_dedup(frame.limit(0)).count() == 0


def test_passages_behind_an_unrelated_first_document_are_found(spark):
    rng = random.Random(8)
    prose = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    docs, want = {}, set()
    for k in range(0, 240, 4):
        passage = prose(80)
        docs[k] = prose(60) + passage[:40] + prose(60)
        docs |= {k + j: prose(30) + passage + prose(30) for j in (1, 2, 3)}
        want |= {k + 2, k + 3}
    again = prose(30)
    docs[400] = prose(60) + again + prose(100) + again + (tail := prose(50)) + prose(20)
    docs[401] = prose(20) + again + tail + prose(60)
    want.add(401)

    def runs(i):
        """Words of a document that stand in 50 equal words of an earlier one."""
        seen = {tuple(w[p : p + 50]) for j, w in docs.items() if j < i for p in range(len(w) - 49)}
        return {p + q for p in range(len(docs[i]) - 49) if tuple(docs[i][p : p + 50]) in seen for q in range(50)}

    assert want == {i for i in docs if runs(i)}
    frame = spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()], DOCS)
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(frame).collect()}
    assert {i for i, r in got.items() if r.sources} == want
    assert all(r.component_id == (i if i == 400 else 400 if i == 401 else i - i % 4 + (i % 4 > 0)) for i, r in got.items())
    for i in want:
        marked = {w for s in got[i].spans.split(",") for w in range(*map(int, s.split(":")))}
        assert runs(i) <= marked


def test_passages_behind_first_documents_of_both_halves_are_found(spark):
    """Every window of the later two documents has its first partners in two that hold too little of the passage."""
    rng = random.Random(13)
    prose = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    docs = {}
    for k in range(0, 160, 4):
        passage = prose(60)
        docs |= {k: prose(60) + passage[:45] + prose(60), k + 1: prose(60) + passage[15:] + prose(60)}
        docs |= {k + j: prose(60) + passage + prose(60) for j in (2, 3)}
    frame = spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()], DOCS)
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(frame).collect()}
    assert all(got[k + j].component_id == k + j and not got[k + j].n_links for k in range(0, 160, 4) for j in (0, 1))
    met = [k for k in range(0, 160, 4) if got[k + 3].component_id == k + 2 and got[k + 3].sources == [k + 2] and got[k + 3].n_dup_words >= 60]
    assert len(met) >= 38


def test_shipped_setting_against_brute_force_with_boilerplate(spark):
    """Exact passages of 50 words and more, of documents full of phrases and license lines that many others have, too."""
    rng = random.Random(21)
    prose = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    phrases = [prose(rng.randrange(8, 45)) for _ in range(25)]

    def body(n):
        out = []
        while len(out) < n:
            out += rng.choice(phrases) if rng.random() < 0.5 else prose(rng.randrange(3, 15))
        return out

    shared = [rng.choice(phrases) + prose(rng.randrange(15, 60)) for _ in range(60)]
    docs = {}
    for k in range(400):
        text = body(rng.randrange(30, 200))
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.randrange(len(text) + 1)
            text[at:at] = rng.choice(shared)
        docs[k] = text
    docs |= {900: ["tick", "tock"] * 200, 901: ["tick", "tock"] * 150 + prose(60), 902: ["tick"] * 300}
    first, want = {}, set()
    for i, w in docs.items():
        for p in range(len(w) - 49):
            j = first.setdefault(tuple(w[p : p + 50]), i)
            if j != i:
                want.add(i)
    frame = spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()], DOCS)
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(frame).collect()}
    found = {i for i, r in got.items() if r.spans}
    assert len(want) > 150 and len(want & found) >= 0.95 * len(want)
    for i in found:  # what is marked is near some earlier passage: no fewer than four fifths of its shingles are old
        old = {tuple(w[p : p + 5]) for j, w in docs.items() if j < i for p in range(len(w) - 4)}
        for lo, hi in (map(int, s.split(":")) for s in got[i].spans.split(",")):
            mine = {tuple(docs[i][p : p + 5]) for p in range(lo, hi - 4)}
            assert hi - lo >= 50 and len(mine & old) >= 0.79 * len(mine)


def test_substring_dedup_edges(spark):
    words = [f"u{k}" for k in range(70)]
    text = " ".join(words)
    long = " ".join(f"v{k % 7001}" for k in range(150_000))
    lone = " ".join(f"n{k}" for k in range(60))
    rows = [(5, text), (5, text), (3, text.upper()), (None, text), (8, None), (8, ""), (9, "short one"), (4, long), (6, "x " + long), (7, text + " and more"), (7, "other"), (None, lone), (None, "first " + lone), (2, text + " twice"), (2, text + " twice")]
    frame = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as text_id", "2 as key", "3 as n_links")
    got = sorted(((r.doc_id is None, r.doc_id, r.component_id, r.n_links, r.n_dup_words, r.spans, r.sources) for r in substring_dedup.substring_dedup(frame).collect()), key=str)
    # id 2 is the earliest of the passage; of the two texts without an id, that of the larger hash is later
    nameless = [g for g in got if g[0] and g[4] != 70]
    assert sorted(g[3] for g in nameless) == [1, 1] and sorted(g[4] for g in nameless) == [0, 60] and all(g[2] is None and not g[6] for g in nameless)
    want = [
        (False, 2, 2, 2, 0, "", []), (False, 2, 2, 2, 0, "", []), (False, 3, 2, 2, 70, "0:70", [2]), (False, 5, 2, 2, 70, "0:70", [2, 3]), (False, 5, 2, 2, 70, "0:70", [2, 3]), (True, None, 2, 3, 70, "0:70", [2, 3]),
        (False, 7, 2, 1, 70, "0:70", [2]), (False, 7, 7, 0, 0, "", []), (False, 8, 8, 0, 0, "", []), (False, 8, 8, 0, 0, "", []), (False, 9, 9, 0, 0, "", []),
        (False, 4, 4, 1, 0, "", []), (False, 6, 4, 1, 150_000, "1:150001", [4]),
    ]
    got = [g for g in got if g not in nameless]
    assert got == sorted(want, key=str)


def test_passages_with_insertions_match_brute_force(spark):
    import numpy as np

    rng = random.Random(12)
    width, docs, want = substring_dedup.MIN_WORDS - substring_dedup.SHINGLE + 1, {}, {}
    for k in range(0, 120, 2):
        one = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        places = sorted(rng.sample(range(5, 56), rng.choice([1, 1, 2])), reverse=True)
        two = list(one)
        for p in places:
            two[p:p] = [f"n{rng.randrange(10**6)}" for _ in range(rng.choice([1, 3, 5, 7]))]
        docs[k], docs[k + 1] = (one, two) if k % 4 else (two, one)
        a, b = (set(substring_dedup.shingles(" ".join(docs[j]).encode()).tolist()) for j in (k, k + 1))
        want[k + 1] = len(a & b) >= 0.8 * len(a | b)
        for x, y in ((k, k + 1), (k + 1, k)):
            h = [substring_dedup.shingles(" ".join(docs[j]).encode()) for j in (x, y)]
            found = substring_dedup.verified(np.array(h[0]), np.array(h[1]), width, 0.8)
            assert not want[k + 1] or (found and found[0] == (0, len(h[0]) - 1)), (x, y)
    assert 20 < sum(want.values()) < 55
    frame = spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()], DOCS)
    # with many hash functions, no pair is left to chance
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(frame, hashes=12).collect()}
    assert all(got[k].n_dup_words == len(docs[k]) for k in want if want[k])


PAGES = "page_id bigint, url string, html string"


def test_archives_round_trip(spark):
    big, odd = "<p>é</p>" * 40, "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 5
    rows = [(9, "http://b.example/x", big), (3, "https://www.a.example/?q=1", big), (4, "http://b.example/x", "short"), (5, "http://b.example/x", "short"), (6, None, None), (7, "bad url \n", odd), (8, "http://[", odd), (3, "https://www.a.example/?q=1", big), (None, "u", big), (10, "x", "")]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as digest", "2 as size")
    got = [r.asDict() for r in warc.archive_pages(pages, rows_per_file=2, row_bytes=500).collect()]
    assert len(got) == len(rows)
    for r in got:  # every capture can be fetched by its place alone
        fields, block = warc.fetch(r, Path(r["file"].removeprefix("file:")).read_bytes())
        assert warc.entry_of(fields, block, (r["file"], r["offset"], r["length"])) == tuple(r[n] for n in warc._NAMES)
        if r["record_type"] == "response":
            assert hashlib.sha256(block.partition(b"\r\n\r\n")[2]).hexdigest() == r["payload_digest"]
    sizes = {r["file"]: Path(r["file"].removeprefix("file:")).stat().st_size for r in got}
    assert len(sizes) > 1 and all(gzip.decompress(Path(f.removeprefix("file:")).read_bytes()).startswith(b"WARC/1.1") for f in sizes)
    for page, _, html in rows:
        data = (html or "").encode()
        first = min((p for p, _, h in rows if (h or "").encode() == data and p is not None), default=None)
        again = len(data) >= 100 and page != first
        mine = [r for r in got if r["page_id"] == page]
        for r in mine:
            assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
            assert (r["record_type"], r["refers_to"]) == (("revisit", first) if again else ("response", None))
    keys = [warc._order(tuple(r[n] for n in warc._NAMES)) for r in got]
    assert keys == sorted(keys)
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_reader_takes_members_and_refuses_damage():
    one = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    packed = gzip.compress(one)
    found = [*warc.members(memoryview(packed + gzip.compress(b"") + packed))]
    assert [(at, n) for at, n, _ in found] == [(0, len(packed)), (len(packed) + len(gzip.compress(b"")), len(packed))]
    assert [warc.read_record(x)[1] for _, _, x in found] == [b"hello"] * 2
    for bad in (one[:-6], one + b"x", b"HTTP/1.1 200\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.read_record(bad)
    with pytest.raises(ValueError):
        list(warc.members(memoryview(packed[:-3])))


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted(((f"u{rng.randrange(5)}", "t", rng.randrange(9), 1, "d", "response", None, "f", 0, 1) for _ in range(rng.randrange(20))), key=warc._order) for _ in range(k)]
    assert list(warc.LoserTree(map(iter, runs))) == sorted(sum(runs, []), key=warc._order)


def test_line_dedup_tells_documents_apart_by_id_and_text(spark):
    four = [(None, "alpha beta\nalpha beta"), (None, "x y\nquite unique line here"), (1, "p q r\np q r"), (1, "s t\nanother wholly unique line")]
    got = {r.text for r in line_dedup.dedup_lines(spark.createDataFrame(four, DOCS)).collect()}
    assert got == {"alpha beta", "x y\nquite unique line here", "p q r", "s t\nanother wholly unique line"}
    rng = random.Random(17)
    base = [" ".join(rng.choices("abcdef", k=rng.choice([2, 5, 7]))) for _ in range(30)]
    rows = list(dict.fromkeys((rng.choice([None, None, 3, 3, 8, 9]), "\n".join(rng.choices(base, k=rng.randrange(1, 6)))) for _ in range(70)))
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest(r[1], seed=42))))
    want = plain_lines([(k, t) for k, (_, t) in enumerate(ordered)])
    frame = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as s", "2 as z", "3 as doc", "4 as own_0").repartition(5)
    found = {(r.doc_id, frozenset(r.removed), r.text) for r in line_dedup.dedup_lines(frame).collect()}
    assert found == {(i, frozenset(want[k]), "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[k])) for k, (i, t) in enumerate(ordered)}


def test_keep_first_leaves_other_columns_alone(spark):
    rows = [(1, "one two three four"), (2, "one two three four"), (2, "one two three four"), (None, "five six seven"), (None, "five six seven")]
    frame = spark.createDataFrame(rows, DOCS).selectExpr("*", "'mine' as gone_id_", "'too' as gone_same_", "'r' as row", "'o' as own_id", "'s' as own_same", "'f' as fp", "'g' as `group`")
    got = simhash.keep_first(frame)
    assert got.columns == frame.columns
    assert sorted((r.doc_id or 0, r.gone_id_, r.gone_same_, r.row, r.own_id, r.own_same, r.fp, r.group) for r in got.collect()) == [(k, "mine", "too", "r", "o", "s", "f", "g") for k in (0, 1)]


@pytest.fixture
def small_partitions(spark):
    settings = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_hot_line_is_split_in_the_join(spark, small_partitions):
    docs = spark.range(20_000).selectExpr("id as doc_id", "concat('the one very common line of all texts\\nown line ', id) as text").repartition(8)
    removed = line_dedup.removed_lines(docs)
    assert removed.where("line = 0").count() == 19_999
    removed.collect()
    assert "skew=true" in removed._jdf.queryExecution().executedPlan().toString()


def test_hot_payload_is_split_in_the_join(spark, small_partitions):
    pages = spark.range(20_000).selectExpr("id as page_id", "'u' as url", "case when id % 5 = 0 then repeat(md5(string(id)), 4) else repeat('gone ', 30) end as html").repartition(8)
    decided = warc.decide(pages)
    assert sum(r.refers_to == 1 for r in decided.collect()) == 15_999
    assert "skew=true" in decided._jdf.queryExecution().executedPlan().toString()


def test_simhash_passes_no_table_through_the_driver(spark, monkeypatch):
    plans = []

    def noted(df, name, stash=simhash.stash):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stash(df, name)

    monkeypatch.setattr(simhash, "stash", noted)
    monkeypatch.setattr(components, "stash", noted)
    docs = spark.createDataFrame([(i, f"w{i // 2} common words of a text {i // 4}") for i in range(40)], "doc_id bigint, text string")
    for result in (simhash.simhash_groups(docs), simhash.keep_first(docs)):
        plans.append(result._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 10 and any("SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if "Broadcast" in p]


def test_collisions_are_shuffled_as_rows_and_verified_in_rounds(spark):
    import numpy as np

    rng = np.random.default_rng(11)
    hits = {(x, a): [] for x in range(40) for a in range(x)}
    for pair in [*hits, *[(39, 2)] * 5000]:  # a pair that fills more than one batch
        cx, ca, *wide = rng.integers(0, 9000, 2).tolist() + rng.integers(20, 60, 4).tolist()
        hits[pair].append((cx, ca, *wide))
    rows = [(x, a, *h) for (x, a), some in hits.items() for h in some]
    pairs = spark.createDataFrame(rows, "x bigint, a bigint, cx int, ca int, left int, right int, a_left int, a_right int").repartition(7)
    joined = substring_dedup._stretches(pairs, 46, 0.8)
    want = sorted((*pair, *s) for pair, some in hits.items() for s in substring_dedup.join_intervals(some, 46, 0.8))
    assert sorted(map(tuple, joined.collect())) == want
    # lists gathered before the shuffle hold a row each, at several times its size
    assert "ObjectHashAggregate" not in joined._jdf.queryExecution().executedPlan().toString()

    words = [f"w{k}" for k in rng.permutation(4000)]
    texts = [" ".join(words[60 * k : 60 * k + 400] + words[3000:3070]) for k in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = substring_dedup.windows(docs, "doc_id", "text", 50, 0.8, 3)
    met = substring_dedup.collisions(substring_dedup.shared_windows(found))
    once, rounds = (sorted(map(tuple, substring_dedup.passages(docs, found, met, **how).distinct().collect())) for how in ({}, {"together": 1}))
    assert len(once) > 30 and once == rounds


def test_no_join_of_simhash_and_of_components_is_broadcast(spark, monkeypatch):
    told, real = [], simhash.stash

    def spy(df, name):
        told.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(simhash, "stash", spy)
    monkeypatch.setattr(components, "stash", spy)
    rng = random.Random(8)
    docs = spark.createDataFrame([(k, " ".join(rng.choices("abcdefgh", k=9))) for k in range(60)], DOCS)
    out = simhash.simhash_groups(docs)
    told.append(out._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in x for x in told)
    assert not any("BroadcastHashJoin" in x for x in told)

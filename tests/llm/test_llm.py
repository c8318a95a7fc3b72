"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, no rows, clashing columns; against
brute force, a library, or an exact round trip."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from weftlog.llm import chat, decontam, linededup, media, mixing, ngramjoin, quality, queries, secrets, tokens, urls

LONG = " ".join(f"w{i}" for i in range(30_000))
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, texts, **more):
    rows = [(i, t, *[v[i] for v in more.values()]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string" + "".join(f", {k} string" for k in more))


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# 1


def brute_passages(text, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    own, hit, found = lower(text), set(), set()
    for ident, t in items:
        w = lower(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(own) - n + 1):
                if own[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(ident)
    return len(own), len(hit), sorted(x for x in found if x is not None) + [None] * (None in found)


def test_passages(spark):
    rng = random.Random(1)
    vocab = ["Alpha", "beta", "gämma", "d1", "E"]
    items = [("a", "Alpha beta, gämma; d1 E alpha BETA gamma x y z"), ("b", "short ITEM"), ("b", "short ITEM"), ("c", ""), ("d", None), (None, "d1 E alpha beta"), (None, "beta gämma"), ("e", " ".join(rng.choice(vocab) for _ in range(30)))]
    texts = [None, "", "!!", "the Short—no short,item here short item", "q " + items[0][1].upper().replace("Ä", "ä") + " r", items[7][1] + " " + items[7][1], " ".join(rng.choice(vocab) for _ in range(300)), LONG + " short item", "alpha beta gämma d1"]
    bench = spark.createDataFrame(items, "item_id string, text string")
    docs = docs_of(spark, texts, n_hit=["x"] * len(texts))
    for size in (decontam.BLOCK_WORDS, 15, 3):
        got = by_id(decontam.find_passages(docs, bench, block_words=size))
        for i, t in enumerate(texts):
            n, hit, found = brute_passages(t, items) if i != 7 else (30_002, 2, ["b"])
            assert (got[i]["n_words"], got[i]["n_hit"], got[i]["hit_items"]) == (n, hit, found), (size, i)
            if hit:
                spans = [t[s["start"] : s["end"]] for s in got[i]["hit_spans"]]
                assert sum(brute_passages(s, [])[0] for s in spans) == hit
    assert decontam.find_passages(docs.limit(0), bench).count() == 0
    assert decontam.find_passages(docs.limit(0), bench, block_words=15).count() == 0
    assert all(r["n_hit"] == 0 for r in decontam.find_passages(docs, bench.limit(0)).collect())


def test_blocks_of_a_long_item(spark):
    """An item of more different words than a block has: no block is larger, and no window is lost at a cut."""
    n, size = 30_000, 7000
    item = " ".join(f"{i:x}" for i in range(n))
    rows = spark.createDataFrame([("a", item), ("b", "x y"), ("c", ""), ("d", " ".join(["z"] * 10))], "id string, text string")
    blocks = list(decontam.blocks_of(rows, 10, size))
    assert len(blocks) == 5 and all(sum(len(w) for _, w in b) <= size + 10 for b in blocks)
    windows = {tuple(w[i : i + 10]) for b in blocks for name, w in b if name == "a" for i in range(len(w) - 9)}
    assert len(windows) == n - 9 and {name for b in blocks for name, _ in b} == {"a", "b", "d"}
    texts = [" ".join(f"{i:x}" for i in range(a, a + 10)) for a in (0, size - 5, n - 10)] + ["x y", "z z", " ".join(f"{i:x}" for i in range(9))]
    got = by_id(decontam.find_passages(docs_of(spark, texts), rows, item_col="id", block_words=size))
    assert [(got[i]["n_hit"], got[i]["hit_items"]) for i in range(len(texts))] == [(10, ["a"])] * 3 + [(2, ["b"]), (0, []), (0, [])]


# 2


def test_chat_round_trip(spark):
    nasty = ["", "#", "####", "</turn>", "</turn", "\\", "\\\\###", "<</turn>>", "### User: hi </turn>\n", "é🙂\n", "\\### Assistant: </turn> ok", "a" * 100_000, "##", "<", " "]
    roles = ["user", "assistant", "system", "tool", "odd: role", "", "User", "###", "\\x"]
    made, start, stop = chat.assemble([roles[i % len(roles)].encode() for i in range(len(nasty))], [t.encode() for t in nasty])
    for i, f in enumerate(made.to_pylist()):
        raw = f.encode()
        assert chat.read_turn(raw) == (roles[i % len(roles)].encode(), nasty[i].encode())
        assert chat.unescape(raw[start[i] : stop[i]]) == nasty[i].encode()
        body = raw[len(chat.header(roles[i % len(roles)].encode())) : -len(b" </turn>\n")]
        assert not re.search(rb"(?<!\\)(?:\\\\)*(?:###|</turn>)", b"x" + body)
    rows = [(1, 1, "assistant", "b#"), (1, 0, "user", None), (1, 1, "assistant", "b#"), (None, 0, None, "x"), (2, 5, "assistant", ""), (2, None, "user", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = by_id(chat.digest_conversations(chat.format_turns(df)), "conv_id")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\n\nassistant\nb#\nassistant\nb#\n") and got[1]["loss_chars"] == 4 and got[1]["loss_sha256"] == sha("b#b#")
    assert got[2]["turns_sha256"] == sha("user\nfirst\nassistant\n\n") and got[None]["turns_sha256"] == sha("\nx\n") and got[None]["loss_chars"] == 0
    assert chat.digest_conversations(chat.format_turns(df.limit(0))).count() == 0


# 3


def brute_secrets(text):
    """Said anew, without the module's own patterns."""
    text = text or ""
    kinds = [
        ("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
        ("access", "AKIA[A-Z0-9]+", 0, 18),
        ("hex", "[0-9a-f]+", 0, 16),
    ]
    base = sorted((m.start(), k, m.end()) for k, (_, pattern, group, least) in enumerate(kinds) for m in re.finditer(pattern, text, re.A) if len(m[group]) >= least)
    spans = list(base)
    for k, run, needs, bits in ((3, r"(?<![0-9A-Za-z])[0-9a-fA-F]{24,}(?![0-9A-Za-z])", ("[0-9]", "[a-fA-F]"), 3.0), (4, r"[A-Za-z0-9+/_=-]{24,}", ("[0-9]", "[a-z]", "[A-Z]"), 3.9)):
        for m in re.finditer(run, text, re.A):
            own, low = m[0], m[0].lower()
            parts = re.split("[-_]", own)
            uuid = re.fullmatch("[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", low)
            version = len(parts) > 1 and re.fullmatch("[0-9]{1,4}", parts[0]) and all(re.fullmatch("[0-9A-Za-z]{1,8}", p) for p in parts[1:])
            pieces = re.split("[/_-]", own[1:] if own[0] in "/_-" else own)
            pieces = pieces[:-1] if not pieces[-1] else pieces
            path = len(pieces) > 1 and all(re.fullmatch("[A-Za-z]+", p) for p in pieces)
            known = any(x in low for x in ("example", "sample", "dummy", "placeholder", "xxxx", "0123456789", "abcdefghij"))
            if any(not re.search(x, own) for x in needs) or uuid or version or path or known or any(a <= m.start() and b >= m.end() for a, _, b in base):
                continue
            high = [i for i in range(len(own) - 23) if -sum(n / 24 * math.log2(n / 24) for n in Counter(own[i : i + 24]).values()) >= bits - 1e-7]
            if high:
                spans.append((m.start() + high[0], k, m.start() + high[-1] + 24))
    names = [k[0] for k in kinds] + ["hexmix", "base64"]
    show = lambda s: ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(s))
    return show(base), show(spans)


def test_secrets(spark):
    rng = random.Random(3)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    key = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    texts = [None, "", "token: secret: abcdefghijklmnop", 'Api_Key = "' + key(20) + '" x', "AKIA" + "A" * 14 + " AKIAB", "é" + "deadbeef" * 3 + " 0123456789abcdef", key(60), "x " + key(30) + "." + key(25), "0F9a" * 8, "DEADBEEF1234567890ABCDEF12345678", "550e8400-e29b-41d4-a716-446655440000", "EXAMPLE" + key(40), "a1B" * 12, "a/b/c" * 10, LONG, "PASSWORD=short password=" + "p" * 12 + " password=" + "q" * 11, "🙂" + key(50), key(2000), key(24), "aB1" * 20 + key(40), "/usr/Local/share/Fonts/truetype/x1/" + "a-" * 20]
    texts += ["1" + "-aB1cD2x" * 130_000, "/Abc-dEf" * 20_000 + "/", "1" + "-aB1cD2x" * 3000 + "+", "token=" + key(300_000)]
    df = docs_of(spark, texts, base_spans=["c"] * len(texts)).drop("base_spans")
    found = secrets.find_secrets(df)
    got = by_id(found.select("doc_id", secrets.joined(found["base_spans"]).alias("base"), secrets.joined(found["secret_spans"]).alias("spans")))
    for i, t in enumerate(texts):
        assert (got[i]["base"], got[i]["spans"]) == brute_secrets(t), i
    assert any("base64" in r["spans"] for r in got.values()) and any("hexmix" in r["spans"] for r in got.values())
    assert secrets.find_secrets(df.limit(0)).count() == 0


# 4


def test_media(spark):
    rng = random.Random(4)
    texts = [None, "", "x", "y" * 64, "ä" * 5000, LONG, "x"] + ["".join(chr(rng.randrange(32, 800)) for _ in range(n)) for n in (63, 511, 512, 513, 4096, 4097, 140_000)]
    df = docs_of(spark, texts, feature=["f"] * len(texts))
    one, two = by_id(media.digest_texts(df)), by_id(media.read_media(media.store_texts(df)))
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes((64 - len(raw) % 64) % 64 if raw else 64)
        for r in (one[i], two[i]):
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_ok"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), True)
        assert one[i]["media_sha256"] == two[i]["media_sha256"] and one[i]["feature"] == two[i]["feature"]
    assert one[2]["media_sha256"] == one[6]["media_sha256"]
    packets = media.packet_table(media.store_texts(df)).where("doc_id = 5").orderBy("byte_start").collect()
    assert sum(p["byte_length"] for p in packets) == one[5]["payload_bytes"]
    assert [p["timestamp_ns"] for p in packets] == [64_000_000 * k for k in range(len(packets))]
    assert {p["lacing"] for p in packets} >= {media.FIXED} and media.packet_table(media.store_texts(df.limit(0))).count() == 0


def _file(blocks, unknown=False, extra=b""):
    e = media.element
    cluster = e(media.TIMESTAMP, 7) + b"".join(e(media.SIMPLE_BLOCK, b) for b in blocks) + extra
    size = b"\x01\xff\xff\xff\xff\xff\xff\xff" if unknown else media.size_bytes(len(cluster))
    body = media._TRACK + media.CLUSTER.to_bytes(4, "big") + size + cluster + e(media.CUES, b"")
    return media._HEAD + media.SEGMENT.to_bytes(4, "big") + (b"\x01\xff\xff\xff\xff\xff\xff\xff" if unknown else media.size_bytes(len(body))) + body


def test_matroska_forms():
    head = b"\x81\x00\x03"
    xiph = head + bytes([media.XIPH << 1]) + bytes([2, 255, 45, 0]) + b"a" * 300 + b"b" * 5
    ebml = head + bytes([media.EBML_LACING << 1]) + media.lace([b"x" * 600, b"y" * 500, b"z" * 700, b"w"])[1]
    plain = head + b"\x80" + b"plain"
    for unknown in (False, True):
        group = media.element(media.BLOCK_GROUP, media.element(media.BLOCK, plain) + media.element(media.REFERENCE, 1))
        m = media.parse(_file([xiph, ebml, plain], unknown, group))
        assert m.ok and [p[3] for p in m.packets] == [300, 0, 5, 600, 500, 700, 1, 5, 5]
        assert m.packets[0][1] == 10_000_000 and m.packets[1][1] == 10_000_000 + 64_000_000 and not m.packets[-1][6] and m.packets[-2][6]
    whole = _file([plain, plain])
    for cut in range(0, len(whole), 7):
        media.parse(whole[:cut])
    assert not media.parse(b"\x00junk").ok and media.parse(whole[:-20]).packets
    for n in (0, 126, 127, 16382, 16383, 1 << 40):
        assert media.read_number(media.size_bytes(n), 0, 9)[0] == n


# 5


def brute_dedup(rows):
    """Every line a chunk: of the shortest runs of neighbouring repeated lines with 20 words, from each line on and up to
    each, all but the first go."""
    words = lambda s: len(WORDS.findall(s))
    low = lambda ident: (ident is not None, ident)
    places, split = {}, {}
    for ident, text in rows:
        split[ident, text] = [(k, p) for k, p in enumerate((text or "").split("\n")) if words(p)]
        for k, p in split[ident, text]:
            places.setdefault(p, set()).add((low(ident), k))
    runs = {}
    for (ident, text), own in split.items():
        for i in range(len(own)):
            for step in (1, -1):
                j, n = i, 0
                while 0 <= j < len(own) and len(places[own[j][1]]) > 1 and n < 20:
                    n += words(own[j][1])
                    j += step
                if n >= 20:
                    a, b = min(i, j - step), max(i, j - step)
                    runs.setdefault(tuple(p for _, p in own[a : b + 1]), set()).add((low(ident), own[a][0], own[b][0], ident, text))
    gone = {}
    for found in runs.values():
        first = min(found, key=lambda x: x[:2])[:2]
        for _, a, b, ident, text in (x for x in found if x[:2] != first):
            gone.setdefault((ident, text), set()).update(range(a, b + 1))
    return [None if t is None else "\n".join(p for k, p in enumerate(t.split("\n")) if k not in gone.get((i, t), ())) for i, t in rows]


def test_line_dedup(spark):
    rng = random.Random(5)
    line = lambda: " ".join(rng.choice("lorem ipsum dolor sit amet magna aliqua".split()) + str(rng.randrange(999)) for _ in range(rng.randrange(1, 30)))
    passage = "\n".join(line() for _ in range(6))
    single = " ".join(f"p{i}" for i in range(60))
    texts = [None, "", "\n\n", line(), "short line", "short line"]
    for _ in range(40):
        parts = [line() for _ in range(rng.randrange(1, 9))]
        if rng.random() < 0.5:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice([passage, single, "licence line"]))
        texts.append("\n".join(parts))
    texts += [texts[10]] * 3 + [texts[12] + "\n" + line(), "\n".join(line() for _ in range(2000))]
    rows = [(i if i != 9 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' AS n_removed", "'d' AS source")
    left = linededup.dedup_lines(df)
    got = {r["doc_id"]: r for r in left.collect()}
    for (ident, text), want in zip(rows, brute_dedup(rows), strict=True):
        assert got[ident]["text"] == want, ident
        lost = 0 if text is None else text.count("\n") - want.count("\n") if want else (text.count("\n") + 1 if text else 0)
        assert got[ident]["n_removed"] == lost or want == "" , ident
    assert got[len(texts) - 3]["emptied"] and got[len(texts) - 3]["text"] == "" and not got[0]["emptied"] and not got[1]["emptied"]
    assert sum(single in (r["text"] or "") for r in got.values()) == 1
    assert linededup.dedup_lines(df.limit(0)).count() == 0
    named = [(None if i is None else f"id {i:03}", t) for i, t in rows]
    left = linededup.dedup_lines(spark.createDataFrame(named, "doc_id string, text string"))
    assert {r["doc_id"]: r["text"] for r in left.collect()} == {i: t for (i, _), t in zip(named, brute_dedup(named), strict=True)}


def test_line_dedup_by_shuffle_and_salt(spark, monkeypatch):
    """What is broadcast below a size gives the same beyond it, and hot chunks that are salted the same as others."""
    rows = [(i, f"own line number {i}\n" + "\n".join(f"shared {k} " + "word " * 12 for k in range(i % 4))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name, value in (("FEW_DOCS", 0), ("HOT_PLACES", 7)):
        monkeypatch.setattr(linededup, name, value)
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(df).collect()}
    assert [got[i] for i, _ in rows] == brute_dedup(rows)


def test_rolling_boundaries(spark):
    """With a divisor, chunks are what the rolling hash over line hashes says, and do not move with what stands before."""
    rng = random.Random(66)
    h = lambda s: xxhash.xxh64(s.encode(), seed=42).intdigest() & 0xFFFFFF
    lines = [f"line {rng.randrange(10**6)}" for _ in range(200)]
    texts = ["\n".join(lines), "\n".join(["new first", *lines]), None, ""]
    chunks = docs_of(spark, texts).select("doc_id", linededup.chunk_texts(F.col("text"), 2, 5).alias("c"))
    got = {r["doc_id"]: r["c"] for r in chunks.collect()}
    want, held = [], []
    for i, x in enumerate(lines):
        held.append(x)
        if i == len(lines) - 1 or (h(x) * 31 + (h(lines[i - 1]) if i else 0)) % 5 == 0:
            want.append("\n".join(held))
            held = []
    assert got[0] == want and got[1][2:] == want[len(want) - len(got[1]) + 2 :] and got[2] is None and got[3] == [""]


def test_line_dedup_takes_whole_passages(spark):
    """Passages of short lines go whole, whatever stands around them; repeated lines that never stood together stay."""
    rng = random.Random(6)
    line = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    rows, passages = [], []
    for p in range(40):
        n, own = rng.choice([(6, 10), (4, 14), (3, 7), (10, 5), (7, 3)])
        passage = [line(own) for _ in range(n)]
        if p % 4 == 0:
            passage.insert(2, "")
        passages.append("\n".join(passage))
        for _ in range(3):
            rows.append((len(rows), [line(rng.randrange(3, 19)) for _ in range(rng.randrange(1, 4))], passage, [line(rng.randrange(3, 19)) for _ in range(rng.randrange(0, 4))]))
    common = [line(8) for _ in range(4)]
    n = len(rows)
    rows += [(n + i, [line(12)], [c], [line(12)]) for i, c in enumerate(common)] + [(n + 4, [line(12)], common, [line(12)])]
    df = spark.createDataFrame([(i, "\n".join(a + b + c)) for i, a, b, c in rows], "doc_id long, text string")
    got = {r["doc_id"]: r for r in linededup.dedup_lines(df).collect()}
    for i, a, b, c in rows:
        goes = i < n and i % 3 > 0
        assert got[i]["text"] == "\n".join(a + ([] if goes else b) + c), i
        assert got[i]["n_removed"] == (len(b) if goes else 0)


def test_line_dedup_counts_words_of_any_form(spark):
    """Words parted by tabs, and lines of scripts that do not part words, make a repeated run."""
    texts = ["\t".join(f"t{i}" for i in range(60)), "漢字仮名交じり文" * 10, "かな" * 30, "ภาษาไทย" * 10]
    rows = [(k * 2 + i, f"own line {k} {i}\n{t}") for k, t in enumerate(texts) for i in range(2)] + [(90, "own\n短い行"), (91, "other\n短い行"), (92, "a\n\t\t"), (93, "b\n\t\t")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(df).collect()}
    assert got == {i: t.split("\n")[0] if i < 8 and i % 2 else t for i, t in rows}


# 6


def test_apportionment():
    rng = random.Random(6)
    for _ in range(30):
        wanted = {k: rng.choice([0.0, rng.random() * 100, 5.0]) for k in range(rng.randrange(1, 12))}
        most = {k: rng.randrange(0, 200) for k in wanted}
        seats = rng.randrange(0, 300)
        quota = dict.fromkeys(wanted, 0)
        for _ in range(seats):
            open_ = [k for k in wanted if wanted[k] > 0 and quota[k] < most[k]]
            if not open_:
                break
            quota[max(open_, key=lambda k: (wanted[k] / (2 * quota[k] + 1), -k))] += 1
        got = mixing.apportion(wanted, seats, most)
        assert sum(got.values()) == sum(quota.values())
        score = lambda q: sorted(wanted[k] / (2 * n - 1) for k in q for n in [q[k]] if n)
        assert got == quota or score(got) == pytest.approx(score(quota))
    assert mixing.targets([100, 100, 1000], [5, 2, 1]) == pytest.approx([300, 300, 600])
    assert mixing.targets([10, 20], [5, 2]) == pytest.approx([150 / 7, 60 / 7])


def brute_targets(sizes, weights, most=3):
    """Water is poured by weight until every vessel stops at most times its size: the level is found by bisection."""
    low, high = 0.0, most * max(sizes, default=0) / min(weights) + 1
    for _ in range(200):
        level = (low + high) / 2
        if sum(min(most * s, w * level) for s, w in zip(sizes, weights, strict=True)) < sum(sizes):
            low = level
        else:
            high = level
    return [min(most * s, w * high) for s, w in zip(sizes, weights, strict=True)]


def test_targets_against_bisection():
    rng = random.Random(61)
    for _ in range(50):
        sizes = [rng.choice([0, 1, rng.randrange(1, 50), rng.randrange(1, 100_000)]) for _ in range(rng.randrange(1, 9))]
        weights = [rng.choice([5, 2, 1]) for _ in sizes]
        assert mixing.targets(sizes, weights) == pytest.approx(brute_targets(sizes, weights), abs=1e-6), (sizes, weights)


@pytest.mark.parametrize("words", [1, 3])
def test_mixing_few_words(spark, words):
    """Fifty documents of one word, or three: sources come within a word or two of their targets."""
    docs = spark.createDataFrame([(i, "w " * words, "abcde"[i % 5]) for i in range(50)], "doc_id long, text string, source string")
    taken, want = Counter(), brute_targets([10 * words] * 5, [5, 2, 1, 5, 2])
    for r in mixing.mix(docs).collect():
        assert 0 <= r["taken"] <= 3 * r["size"] and r["target"] == pytest.approx(want["abcde".index(r["source"])], abs=1e-6)
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - t) <= 1.5 for s, t in zip("abcde", want, strict=True)), taken


def test_mixing(spark):
    rng = random.Random(7)
    texts = [" ".join("w" for _ in range(rng.randrange(0, 400))) for _ in range(400)] + [None, "", LONG, "a\tb\x0bc\xa0d"]
    sources = [rng.choice(["a", "b", "z", "hot", "hot", "hot"]) for _ in texts[:-4]] + [None, "", None, "a"]
    df = docs_of(spark, texts, source=sources, size=["c"] * len(texts), target=["t"] * len(texts))
    got = by_id(mixing.mix(df))
    assert got[len(texts) - 1]["size"] == 3 and got[len(texts) - 4]["size"] == 0
    sizes = Counter()
    for i, t in enumerate(texts):
        sizes[sources[i]] += len(WORDS.findall(t or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, brute_targets([sizes[n] for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    taken = Counter()
    for i, r in got.items():
        assert r["source_size"] == sizes[sources[i]] and r["target"] == pytest.approx(want[sources[i]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[sources[i]] += r["taken"]
    for n in names:
        assert abs(taken[n] - want[n]) <= 4 * mixing.BLOCK, n
    again = by_id(mixing.mix(df.repartition(7)))
    assert {i: r["taken"] for i, r in got.items()} == {i: r["taken"] for i, r in again.items()}
    assert mixing.mix(df.limit(0)).count() == 0


# 7


def test_quality(spark):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice("the of and river stone cloud walks under green light".split()) for _ in range(rng.randrange(20, 80))) + "."
    junk = lambda: " ".join(rng.choice("CLICK BUY $$$ !!! >>> FREE".split()) + "!!" for _ in range(rng.randrange(20, 80)))
    texts = [good() if i % 3 else junk() for i in range(300)] + [None, "", "   ", LONG, good()]
    df = docs_of(spark, texts, score=["c"] * len(texts))
    labels = spark.createDataFrame([(i, int(bool(i % 3)), 0) for i in range(200)] + [(5, None, 0), (None, 1, 0), (9999, 1, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(df, labels)
    got = by_id(quality.score_quality(df, model))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    right = sum((got[i]["score"] >= 0.5) == bool(i % 3) for i in range(200, 300))
    assert right >= 97
    again = quality.fit(df.repartition(5), labels)
    assert (again[0] == model[0]).all() and again[1].temperature == model[1].temperature
    none = quality.fit(df, labels.limit(0))
    assert {round(r["score"], 6) for r in quality.score_quality(df, none).collect()} == {0.5}
    assert quality.score_quality(df.limit(0), model).count() == 0


def test_word_vectors_against_plain_loops(spark):
    """Words, context sums, pooling and the temperature, each said anew word by word."""
    rng = random.Random(81)
    texts = ["", " \t", "a", "The the The The, the", "x  !!x 12ab\n\nab ab", "Ünï\xa0cödé 🙂🙂 ok-ok ok"] + [" ".join(rng.choice(["red", "Blue", "42", "...", "sky\n", "é"]) for _ in range(rng.randrange(1, 40))) for _ in range(30)]
    kind = lambda b: 0 if b in b" \t\x0b\x0c\r" else 4 if b == 10 else 2 if 48 <= b < 58 else 1 if b >= 128 or chr(b).isalpha() else 3
    names: dict = {}

    def plain(raw):
        runs = []
        for b in raw:
            if runs and runs[-1][0] == kind(b):
                runs[-1][1].append(b)
            else:
                runs.append((kind(b), [b]))
        out, before = [], None
        for k, run in runs:
            if k == 1:
                out.append("again" if run == before else bytes(run))
                before = run
            elif k:
                out.append(bytes(run))
        return out

    for t in texts:
        got, want = quality.buckets_of(t.encode()), plain(t.encode())
        assert len(got) == len(want)
        for bucket, word in zip(got, want, strict=True):
            assert names.setdefault(word, bucket) == bucket
    assert names["again"] == quality.REPEAT and len(set(names.values())) >= len(names) - 1
    index = quality.index_vectors()
    assert (np.abs(index).sum(1) == quality.NONZERO).all()
    want = np.zeros(index.shape, np.int64)
    for t in texts:
        own = quality.buckets_of(t.encode())
        for i in range(len(own)):
            for j in range(max(0, i - quality.NEIGHBOURS), min(len(own), i + quality.NEIGHBOURS + 1)):
                if i != j:
                    want[own[i]] += index[own[j]]
    vectors = index / quality.NONZERO**0.5 + want / np.maximum(1, np.linalg.norm(want, axis=1, keepdims=True))
    assert np.allclose(quality._context(docs_of(spark, texts).selectExpr("text AS _text")), vectors, atol=1e-6)
    for t in texts:
        own = quality.buckets_of(t.encode())
        mean = sum((vectors[b] for b in own), np.zeros(quality.DIMENSIONS)) / max(1, len(own))
        assert np.allclose(quality.pooled(t.encode(), vectors.astype(np.float32)), mean, atol=1e-5)
    x = np.random.default_rng(5).normal(0, 1, (500, quality.DIMENSIONS))
    y = (x[:, 0] + np.random.default_rng(6).normal(0, 1, 500) > 0).astype(int)
    net = quality.train(x, y)
    aside = np.random.default_rng(quality.SEED).random(500) < 0.2
    logits = np.tanh(np.clip((x - net.mean) / net.spread, -quality.REACH, quality.REACH) @ net.first + net.first_bias) @ net.second + net.second_bias
    loss = lambda c: -np.mean(np.log(np.where(y[aside] == 1, 1 / (1 + np.exp(-logits[aside] / c)), 1 / (1 + np.exp(logits[aside] / c)))))
    assert all(loss(net.temperature) <= loss(c) + 1e-9 for c in np.geomspace(0.25, 16, 97))
    assert np.allclose(net.score(x), 1 / (1 + np.exp(-logits / net.temperature)))


# 8


def test_tokens(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(9)
    texts = [None, "", " ", "\n\n  x", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endof", "it's 123 ok!? don't", "日本語 é\u2003x", "a" * 5000, "ab" * 3000, LONG] + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(32, 1000), 32, 10])) for _ in range(200)) for _ in range(60)]
    df = docs_of(spark, texts, n_tokens=["c"] * len(texts))
    got = by_id(tokens.count_tokens(df, path))
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [got[i]["n_tokens"] for i in range(len(texts))] == want
    assert all(got[i]["n_bytes"] == len((t or "").encode()) for i, t in enumerate(texts))
    assert tokens.count_tokens(df.limit(0), path).count() == 0


# 9


def test_urls(spark):
    rng = random.Random(10)
    hosts, paths = ["org", "example.org", "a.example.org", "b.a.example.org", "com", "x.com", "examples.org", "org.example"], ["", "/", "/e", "/en/", "/en/1", "/en/12/", "/fr", "/fr/x"]
    urls_ = [None, "", "no scheme", "http://", "://org/x", "HTTP://A.EXAMPLE.ORG/En/1", "http://example.org?x=/en/", "http://example.org#/en/", "http://example.org:80/en/1", "a://b://org/en/1", "http://.org/en/1", "http://org./en/1"]
    urls_ += ["aé🙂" * 40_000, "a🙂" * 60_000 + "://x.com/" + "🙂b" * 60_000, "http://" + "x🙂." * 40_000 + "example.org/en/1"]
    urls_ += [f"https://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=1', '#t'])}" for _ in range(300)] + ["https://a.example.org/en/1"] * 200
    rules = [(h, p, rng.choice(["allow", "block"])) for h in hosts[:6] for p in paths[1:] if rng.random() < 0.6] + [("org", "/", "allow"), ("org", "/", "allow"), (None, "/", "block")]
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values()) + [("org", "/", "allow")] * 0
    pages = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls_)], "page_id long, url string, verdict string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = by_id(urls.judge_urls(pages, table), "page_id")
    for i, u in enumerate(urls_):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits)[3:] if fits else (None, "allow")
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, *want), u
    assert len(got) == len(urls_) and urls.judge_urls(pages.limit(0), table).count() == 0
    assert {r["rule"] for r in urls.judge_urls(pages, table.limit(0)).collect()} == {None}


# 10


def brute_join(rows, width, percent):
    def grams(t):
        w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        k = min(width, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (ident, _) in enumerate(rows):
        least.setdefault(root(i), []).append(ident)
    return [(ident, len(sets[i]), min(least[root(i)])) for i, (ident, _) in enumerate(rows)]


@pytest.mark.parametrize(("width", "percent", "short"), [(3, 90, 32), (5, 80, 32), (3, 90, 3)])
def test_ngram_join(spark, monkeypatch, width, percent, short):
    monkeypatch.setattr(ngramjoin, "SHORT", short)
    monkeypatch.setattr(ngramjoin, "BLOCK_SHINGLES", 2000 if short == 3 else 1 << 21)
    monkeypatch.setattr(ngramjoin, "MEMBERS", 20)
    rng = random.Random(width * percent)
    vocab = [f"v{i}" for i in range(400)]
    texts = [None, "", "one", "one", "ONE", "one two", "one two three", " one  two\tthree ", LONG, LONG + " tail", "nbsp\xa0word x y z"]
    boiler = " ".join(vocab[:20])
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randrange(10, 120))]
        for _ in range(rng.randrange(1, 14)):
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append((boiler + " " if rng.random() < 0.3 else "") + " ".join(w))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' AS class", "'d' AS n", "'e' AS component_id")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngramjoin.jaccard_components(df, width, percent).collect())
    assert got == brute_join(rows, width, percent)


def test_ngram_join_rows(spark):
    df = spark.createDataFrame([(3, "a b c d"), (3, "a b c d"), (None, "x y z w"), (None, ""), (4, "q r s t")], "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngramjoin.jaccard_components(df, 3, 90).collect())
    assert got == {(3, 2, 3): 2, (None, 2, None): 1, (None, 0, None): 1, (4, 2, 4): 1}
    assert ngramjoin.jaccard_components(df.limit(0), 3, 90).count() == 0


def test_every_contract_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 11))


def test_quality_of_texts_unlike_all_learned_from():
    """An input that never varied says nothing, and none counts further out than REACH."""
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (200, quality.DIMENSIONS))
    x[:, -1] = 0.25
    net = quality.train(x, (x[:, 0] > 0).astype(int))
    odd = x[:5].copy()
    odd[:, -1] = 9
    assert np.allclose(net.score(odd), net.score(x[:5]))
    odd[:, 1], far = 1e6, x[:5].copy()
    far[:, 1] = net.mean[1] + quality.REACH * net.spread[1]
    assert np.allclose(net.score(odd), net.score(far))

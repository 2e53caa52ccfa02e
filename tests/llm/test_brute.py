"""Each operator against a brute-force version, over the smallest table and over a table of odd rows."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, a string, chunk long, node long, size long, part int, _turn int, _share string, _doc long, toxic_score double, toxic_predicted int, tag long, copies map<string,int>, `row` string, shard int, slot long, block int"

LONG = "the quick brown fox jumps over the lazy dog and runs " * 40
ODD = [
    (5, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one two"), (6, "one two three"), (7, "ONE Two three"), (8, "one two three four"), (9, LONG), (10, LONG + " more"), (11, LONG.upper()),
    (12, "x" * 200), (13, "y" + "x" * 120), (14, "é" * 60), (15, "ü" + "é" * 40), (16, "a\nb\nc\nd\n\n\n\nq"), (17, "z\na\nb\nc\nd"), (18, "a\nb\nc"), (19, "\n\n\n\n\n"), (9, LONG), (20, "a b c " * 3000),
    (21, "mail a.b@c.de and +49 (30) 1234567, 10.0.0.1.5.6.7.8 card 4111 1111 1111 1111 or 4111111111111112"), (22, "a@b.c.d@e.f _x@y.z +1 2 300.1.1.1 0004.010.1.255 41111111111111111111"), (23, "💥 é@é.com ü 127.0.0.1 💥+123456789💥"),
]


def odd(spark):
    more = ("a", 1, 2, 3, 4, 5, "b", 6, 0.9, 1, 7, {"k": 1}, "c", 8, 9, 10)
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else f"s{i % 3}", None, *more) for i, t in ODD]
    rows.append((None, "no id here", *[None] * (len(more) + 3)))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module", params=["table", "odd", "empty"])
def docs(request, spark):
    if request.param == "table":
        return spark.read.parquet(f"{SF}/documents.parquet")
    return odd(spark) if request.param == "odd" else odd(spark).limit(0)


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))


def same(df, expected):
    key = lambda r: tuple((v is None, str(v)) for v in r)
    got = rows(df)
    assert got == sorted(expected, key=key)


def test_lines(docs):
    from tessera.llm.op1_lines import dedup

    every = pairs(docs)
    unique = sorted({(d if d is not None else -1, t or "") for d, t in every})
    if len({d for d, _ in unique}) != len(unique):
        pytest.skip("order of texts that share a doc_id is a hash's")
    seen, gone = {}, set()
    for d, t in unique:
        lines = t.split("\n")
        for n in (1, 2, 3):
            for i in range(len(lines) - n + 1):
                k = tuple(lines[i : i + n])
                if k in seen and (n == 3 or len(re.findall(r"[^\x20\x09-\x0D]+", " ".join(k))) >= 50):
                    gone |= {(d, i + j) for j in range(n)}
                seen.setdefault(k, (d, i))
    out = []
    for d, t in every:
        lines, own = (t or "").split("\n"), -1 if d is None else d
        dead = [(own, i) in gone for i in range(len(lines))]
        runs = sum(x and not (i and dead[i - 1]) for i, x in enumerate(dead))
        out.append((d, len(lines), sum(dead), runs, "\n".join(x for x, y in zip(lines, dead) if not y)))
    same(dedup(docs), out)


def test_lines_tables(spark, monkeypatch):
    """A round writes its ranks and the next round's runs, the last round nothing; what goes is in these."""
    from tessera.llm import op1_lines

    names, run = [], "one two three four five " * 11
    monkeypatch.setattr(op1_lines, "Written", lambda df, name, make=op1_lines.Written: names.append(name) or make(df, name))
    docs = spark.createDataFrame([(1, f"{run}\na\nb\nc\nd\ne"), (2, f"x\n{run}\ny\nb\nc\nd\ne"), (3, "a\nb")], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_runs, r.kept) for r in op1_lines.dedup(docs).collect()}
    assert got == {1: (0, 0, f"{run}\na\nb\nc\nd\ne"), 2: (5, 2, "x\ny"), 3: (0, 0, "a\nb")}
    assert names == ["lines-1", "ranks-1", "lines-2", "ranks-2", "lines-3"]


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()


def test_pack(docs, spark, model, tmp_path):
    from tokenizers import Tokenizer

    from tessera.llm import op2_pack

    path = str(tmp_path / "tokens")
    op2_pack.write(docs, path, model, 49_408, 2, parts=4, block_ids=500)
    tok = Tokenizer.from_str(model)
    expected, start = {}, 0
    got = [tuple(r) for r in op2_pack.read_digest(spark, path).orderBy("start").collect()]
    for d, t in sorted(pairs(docs), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        expected[start] = (d, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert got == list(expected.values())
    if got:
        some = got[len(got) // 2][0]
        ids = [tok.encode(t or "", add_special_tokens=False).ids + [2] for d, t in pairs(docs) if d == some]
        assert op2_pack.fetch(spark, path, some) == ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pack_encoder(name):
    """Any tokenizer's ids are the library's, also where words can't be encoded one by one."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from tessera.llm.op2_pack import WordEncoder

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        model = f.read()
    encode, known = WordEncoder(model), Tokenizer.from_str(model)
    for text in [t or "" for _, t in ODD[:-4]] + ["It's  a\u00a0b\tC\r\nd", "İstanbul ΑΣ ß ﬁ", "x<|endoftext|>y 12a3,.", "e\u0301 \u0301 ..a"]:
        assert np.frombuffer(encode(text), "<u4").tolist() == known.encode(text, add_special_tokens=False).ids, text


def test_pack_words(model):
    """New words are encoded many at a time, marks behind them apart, whatever letters, marks and rows there are; ids are the library's."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    from tessera.llm.op2_pack import WordEncoder

    class Counted:
        def __init__(self, inner):
            self.inner, self.texts = inner, 0

        def encode_batch_fast(self, texts, **more):
            self.texts += len(texts)
            return self.inner.encode_batch_fast(texts, **more)

    known = Tokenizer.from_str(model)
    ids = lambda text: known.encode(text or "", add_special_tokens=False).ids
    marks = [".", ",", "***", "!?", ""]
    text = " ".join("".join("abcdefghij"[int(d)] for d in str(7919 * i)).capitalize() + marks[i % 5] for i in range(1, 2001))
    encode = WordEncoder(model)
    encode.tokenizer = counted = Counted(encode.tokenizer)
    assert np.frombuffer(encode(text), "<u4").tolist() == ids(text) and counted.texts <= 20
    encode = WordEncoder(model)
    encode.ends[:] = False  # no id says that a word ends
    assert np.frombuffer(encode(text), "<u4").tolist() == ids(text)

    encode, signs = WordEncoder(model, 2), [chr(c) for c in range(0x250)]
    odd = [f"A{c}b{m} {c}{m} x{m}{c} {m}{c}y" for c in signs for m in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]
    texts = [None, "", " ", "\n\n", *odd, "<|endoftext|>... <|ENDOFTEXT|> a<|", "A" * 5000 + "...", None]
    for rows in (pa.array(texts), pa.array(texts).slice(1, 9), pa.array(texts, pa.large_string()), pa.array([], pa.string())):
        got = [np.frombuffer(b, "<u2").tolist() for b in encode.batch(rows)]
        assert got == [ids(t) for t in rows.to_pylist()]
    assert max(map(len, encode.known)) <= 48


def test_pack_hot(spark, model, tmp_path):
    """A doc_id, and none, on a third of all rows each fill several parts; the order stays, and null ids come back as null."""
    from tessera.llm import op2_pack

    docs = spark.range(900).selectExpr("case when id % 3 = 0 then null when id % 3 = 1 then 76 else id end as doc_id", "concat('word ', id) as text")
    path = str(tmp_path / "t")
    op2_pack.write(docs, path, model, 49_408, 2, parts=9, block_ids=200)
    parts = {}
    for r in spark.read.parquet(path).collect():
        parts[r.part] = parts.get(r.part, 0) + r.n_ids
    assert max(parts.values()) < 0.25 * sum(parts.values())
    got = sorted(op2_pack.read_digest(spark, path).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == [None] * 300 + sorted([76] * 300 + [i for i in range(900) if i % 3 == 2])
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    assert len(op2_pack.fetch(spark, path, 76)) == 300 and not op2_pack.fetch(spark, path, 0)


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 32])
def test_pack_round_trip(bits):
    from tessera.llm.op2_pack import pack, unpack, width

    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000, dtype=np.uint64).astype(np.uint32)
    data = pack(ids, bits)
    assert len(data) == -(-1000 * bits // 8) and (unpack(data, 1000, bits) == ids).all() and (unpack(data, 10, bits, 77) == ids[77:87]).all()
    assert width(1 << bits) == bits


def luhn(s):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(s))) % 10 == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base(text):
    out = {"email": [], "ip": [], "card": [], "phone": []}
    for m in re.finditer(BASE["email"], text):
        out["email"].append(m.span())
    for m in re.finditer(BASE["ip"], text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out["ip"].append(m.span())
    for m in re.finditer(BASE["card"], text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out["card"].append(m.span())
    for m in re.finditer(BASE["phone"], text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out["phone"].append(m.span())
    return out


def pii(texts):
    """All spans (kind, start, end) and the sanitised text of each text, by plain loops."""
    import math

    import regex

    held, df_e, df_t, df_et = [], {}, {}, {}
    for t in texts:
        spans = base(t) | {"secret": [m.span() for m in re.finditer("[A-Za-z0-9]{20,}", t) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]}
        cuts = {k: [m.span() for m in re.finditer(p, t)] for k, p in (BASE | {"secret": "[A-Za-z0-9]{20,}"}).items()}
        cuts["card"] = [(a, b) for a, b in cuts["card"] if 16 <= sum(c in "0123456789" for c in t[a:b]) <= 19]
        around = []
        for k, found in spans.items():
            for a, b in found:
                low, high = max([e for _, e in cuts[k] if e <= a], default=0), min([s for s, _ in cuts[k] if s >= b], default=len(t))
                terms = [(m[0].lower(), low + m.start(), low + m.end()) for m in regex.finditer(r"\p{L}{3,}", t[low:a]) if a - low <= 120 or low + m.start() >= a - 120]
                terms += [(m[0].lower(), b + m.start(), b + m.end()) for m in regex.finditer(r"\p{L}{3,}", t[b:high]) if high - b <= 120 or m.end() <= 120]
                around.append((f"{k}:{t[a:b].lower()}", terms))
        held.append((spans, around))
        for some, counts in (({e for e, _ in around}, df_e), ({w.lower() for w in regex.findall(r"\p{L}{3,}", t)}, df_t), ({(e, w) for e, ts in around for w, _, _ in ts}, df_et)):
            for v in some:
                counts[v] = counts.get(v, 0) + 1
    n, out = len(texts), []
    telling = {(e, w) for (e, w), c in df_et.items() if w in df_t and df_e[e] < n and math.log2(n * c / (df_e[e] * df_t[w])) >= 0.9 * math.log2(n / df_e[e])}
    for t, (spans, around) in zip(texts, held):
        spans = {**spans, "term": sorted({(a, b) for e, ts in around for w, a, b in ts if (e, w) in telling})}
        clean, at = "", 0
        for a, _, b, k in sorted((a, i, b, k) for i, (k, found) in enumerate(spans.items()) for a, b in found):
            if a >= at:
                clean, at = clean + t[at:a] + f"[{k.upper()}]", b
        out.append((spans, clean + t[at:]))
    return out


def test_pii(docs):
    from tessera.llm.op3_pii import digest

    every = pairs(docs)
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    expected = []
    for (d, _), (spans, clean) in zip(every, pii([t or "" for _, t in every]), strict=True):
        listed = {k: ",".join(f"{k}:{s}:{e}" for s, e in v) for k, v in spans.items()}
        some = lambda kinds: ",".join(listed[k] for k in kinds if listed[k])
        n = {k: len(v) for k, v in spans.items()}
        expected.append((d, *(n[k] for k in BASE), sha(some(BASE)), some(spans), n["secret"], n["term"], sum(n[k] for k in (*BASE, "secret")), sha(clean)))
    same(digest(docs), expected)


def test_pii_terms(spark):
    """A term that stands only near one person's address gives it away; words that are everywhere don't."""
    from tessera.llm import op3_pii

    rows = [(i, f"the report of zanzibar unit came from jo@x.org today number {i}") for i in range(6)]
    rows += [(10 + i, f"the report of another unit came today number {i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in op3_pii.digest(docs).collect()}
    assert all("term:14:22" in got[i] for i in range(6)) and all("term:0:3" not in got[i] for i in range(6))
    assert all(not got[10 + i] for i in range(30))
    out = op3_pii.sanitised(op3_pii.find(docs)).where("doc_id = 0").first().clean
    assert "jo@x.org" not in out and "zanzibar" not in out and "[EMAIL]" in out and "[TERM]" in out


def test_pii_terms_table(spark):
    """Most entities are in one or two documents; they have terms as well, and both equal the plain loops."""
    from tessera.llm import op3_pii

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    every = pairs(docs)
    expected = {d: sum(map(len, s.values())) for (d, _), (s, _) in zip(every, pii([t or "" for _, t in every]), strict=True)}
    got = {r.doc_id: r.n_term + r.n_private for r in op3_pii.digest(docs).collect()}
    assert got == expected and sum(expected.values()) > 100


def test_pii_long(spark):
    """One address of 100,000 parts; a megabyte of addresses; digits without end: whole results, in time."""
    import time

    from tessera.llm import op3_pii

    texts = ["a@b" + ".c" * 100_000, "ab@cd.ef " * 110_000, "+1 234 567 89 " * 20_000, "1" * 1_000_000, "x" * 500_000 + "9" * 500_000, "+" + "1(" * 300_000, "1.2.3.4" * 50_000]
    start = time.perf_counter()
    got = {r.doc_id: r for r in op3_pii.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert time.perf_counter() - start < 90
    of = lambda r: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.n_secret)
    assert [of(got[i]) for i in range(len(texts))] == [(1, 0, 0, 0, 0), (110_000, 0, 0, 0, 0), (0, 0, 0, 20_000, 0), (0,) * 5, (0, 0, 0, 0, 1), (0,) * 5, (0, 37_500, 0, 0, 0)]
    listed = ",".join(f"email:{9 * i}:{9 * i + 8}" for i in range(110_000))
    assert got[1].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
    assert got[1].clean_sha256 == hashlib.sha256(("[EMAIL] " * 110_000).encode()).hexdigest()


def test_mix(docs):
    from tessera.llm.op4_mix import mix

    got = mix(docs, block_rows=7).collect()
    every = [(d, t, s) for d, t, s in ((r.doc_id, r.text, r.source) for r in docs.collect())]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(d), size(t)) for d, t, _ in every)
    sums, taken, largest = {}, {}, {}
    for _, t, s in every:
        sums[s] = sums.get(s, 0) + size(t)
        largest[s] = max(largest.get(s, 0), size(t))
    aim = targets(sums, [5, 2, 1])
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.source_size == sums[r.source] and r.target == pytest.approx(aim[r.source]) and 0 <= r.taken <= 3 * r.size and r.taken == r.size * r.copies
    for s in sums:
        assert abs(taken[s] - aim[s]) <= largest[s] + 1e-6
    again = mix(docs.repartition(5), block_rows=7).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def targets(sizes, weights, share=1.0, most=3.0):
    """Shares by weight; what is above its limit is cut and shared again, round by round."""
    names = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weigh = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        unit = left / sum(weigh[s] for s in free)
        over = [s for s in free if unit * weigh[s] > most * sizes[s]]
        if not over:
            return out | {s: unit * weigh[s] for s in free}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def test_mix_targets(spark):
    from tessera.llm import op4_mix

    draw = np.random.default_rng(5)
    cases = [{"a": 100, "b": 10, "c": 1}, {"a": 1, "b": 1, "c": 1000, None: 5}, {"a": 0, "b": 0}, {"a": 0, "b": 7}, {}]
    cases += [{f"s{i:03}": int(draw.pareto(0.4) * 10) for i in range(n)} for n in (5, 40, 300)]
    for sizes in cases:
        for share, most in ((1.0, 3.0), (0.5, 1.0), (4.0, 3.0)):
            rows_ = spark.createDataFrame(list(sizes.items()), "source string, words long")
            got = {r.source: r.target for r in op4_mix.targets(rows_, [5, 2, 1], share, most).collect()}
            assert got == pytest.approx(targets(sizes, [5, 2, 1], share, most)), (sizes, share)


def test_mix_repeats(spark):
    """A row that repeats very often is many documents, spread over the blocks."""
    from tessera.llm.op4_mix import mix

    docs = spark.range(9_000).selectExpr("cast(null as bigint) as doc_id", "if(id < 5000, 'x y z', 'a b') as text", "if(id % 3 = 0, 's', 't') as source")
    got = mix(docs, block_rows=100).groupBy("source", "size").agg({"*": "count", "taken": "sum", "target": "max"}).collect()
    assert sum(r["count(1)"] for r in got) == 9_000
    for s in "st":
        own = [r for r in got if r.source == s]
        assert abs(sum(r["sum(taken)"] for r in own) - own[0]["max(target)"]) <= 3


def test_shard(docs):
    from tessera.llm.op5_shard import shard

    got = shard(docs, block_rows=3).collect()
    want = sorted((str(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in pairs(docs))
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
    slots, by_id = {}, {}
    for r in got:
        assert 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24) and r.law == "key"
        slots.setdefault(r.shard, []).append(r.slot)
        assert by_id.setdefault(r.doc_id, r.shard) == r.shard
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shard_keys(spark):
    """A key's type doesn't matter; no shard moves but to the new one; the short walk gives what the long one does."""
    from pyspark.sql import functions as F

    from tessera.llm import op5_shard

    got = spark.range(2_000).select(*(op5_shard.jump_hash(F.col("id").cast(t), n).alias(f"{t}{n}") for t in ("int", "bigint", "string") for n in (24, 200))).collect()
    assert all(r.int24 == r.bigint24 == r.string24 and r.int200 == r.bigint200 == r.string200 and 0 <= r.int200 < 200 for r in got)
    short = op5_shard.SHORT
    try:
        op5_shard.SHORT = 3
        less = spark.range(2_000).select(op5_shard.jump_hash(F.col("id"), 200).alias("s")).collect()
    finally:
        op5_shard.SHORT = short
    assert [r.s for r in less] == [r.int200 for r in got]
    with pytest.raises(ValueError):
        op5_shard.jump_hash(F.col("id"), 0)


def test_shard_even(spark):
    from tessera.llm.op5_shard import shard

    got = shard(spark.range(24_000).selectExpr("id as doc_id", "'' as text")).groupBy("shard").count().collect()
    assert len(got) == 24 and all(800 < r["count"] < 1200 for r in got)


def brute_bytes(every, size):
    first = {}
    for d, t in every:
        b = (t or "").encode()
        for i in range(len(b) - size + 1):
            w = b[i : i + size]
            k = np.iinfo(np.int64).max if d is None else d
            first[w] = min(first.get(w, k), k)
    out = []
    for d, t in every:
        b, k = (t or "").encode(), np.iinfo(np.int64).max if d is None else d
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if first[b[i : i + size]] < k:
                gone[i : i + size] = True
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most", [50_000, 3])
def test_bwt(docs, most):
    from tessera.llm.op6_bwt import dedup

    same(dedup(docs, most_of_anchor=most).drop("kept"), brute_bytes(pairs(docs), 50))


def test_bwt_hot(spark):
    """A passage in a third of 30,000 documents: all but the first lose it, and nothing else goes."""
    from tessera.llm.op6_bwt import dedup

    draw = np.random.default_rng(12)
    own = lambda n: bytes(draw.integers(97, 123, n, dtype=np.uint8)).decode()
    hot = own(120)
    texts = [(i, own(40) + (hot if i % 3 == 0 else "") + own(20 + i % 7)) for i in range(30_000)]
    got = {r.doc_id: r for r in dedup(spark.createDataFrame(texts, "doc_id long, text string").repartition(16), most_of_anchor=2_000).collect()}
    assert all(got[i].n_removed == (120 if i % 3 == 0 and i else 0) or (got[i].n_removed in range(120, 130) and i % 3 == 0 and i) for i in range(30_000))
    assert all(got[i].n_spans == (1 if i % 3 == 0 and i else 0) for i in range(30_000))


def test_column_bwt():
    """In every column, the order of the suffixes that begin there, and what neighbours share."""
    from tessera.llm.op6_bwt import ColumnBwt

    texts = [(0, b"banana"), (1, b"anana"), (0, b"banana"), (2, b""), (3, b"ana"), (0, b"banane"), (4, b"nab")]
    data = np.frombuffer(b"".join(t for _, t in texts), np.uint8)
    length = np.array([len(t) for _, t in texts])
    bwt = ColumnBwt(data, np.concatenate([[0], np.cumsum(length)[:-1]]), length, np.array([s for s, _ in texts]))
    suffix = lambda i, c: texts[i][1][c - texts[i][0] :]
    while bwt.step():
        c = bwt.column
        here = [i for i, (s, t) in enumerate(texts) if s <= c < s + len(t)]
        got = bwt.order.tolist()
        assert sorted(got) == here and [suffix(i, c) for i in got] == sorted(suffix(i, c) for i in here)
        for a, b, p in zip(got, got[1:], bwt.prefix[1:].tolist()):
            x, y = suffix(a, c), suffix(b, c)
            assert p == next((k for k, (m, n) in enumerate(zip(x, y)) if m != n), min(len(x), len(y)))
        strings, turn = bwt.intervals(3)
        assert sorted(strings.tolist()) == sorted(i for i in here if len(suffix(i, c)) >= 3)
        groups = [{suffix(i, c)[:3] for i in g.tolist()} for g in np.split(strings, turn[1:]) if len(g)]
        assert all(len(g) == 1 for g in groups) and len(set().union(*groups)) == len(groups) if groups else True


def brute_jaccard(every, k, percent):
    def shingle(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    sets = [shingle(t) for _, t in every]
    root = list(range(len(every)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and every[i][0] is not None and every[j][0] is not None:
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(every):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), None if d is None else least[find(i)]) for i, ((d, _), s) in enumerate(zip(every, sets))]


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_jaccard(docs, k, percent):
    from tessera.llm.op9_jaccard import join

    same(join(docs, k, percent).select("doc_id", "n_shingles", "component_id"), brute_jaccard(pairs(docs), k, percent))


def test_jaccard_near(spark, monkeypatch):
    """Many texts near the threshold, in chains, searched in chunks."""
    import random

    from tessera.llm import op9_jaccard

    monkeypatch.setattr(op9_jaccard, "CHUNK", 20)
    draw, rows = random.Random(5), []
    for group in range(6):
        words = [f"w{group}_{i}" for i in range(draw.choice([5, 12, 40, 120, 300]))]
        for _ in range(25):
            words = list(words)
            for _ in range(draw.randint(0, max(1, len(words) // 40))):
                words[draw.randrange(len(words))] = f"n{draw.random()}"
            rows.append((len(rows), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for k, percent in ((3, 90), (5, 80)):
        same(op9_jaccard.join(docs, k, percent).select("doc_id", "n_shingles", "component_id"), brute_jaccard(rows, k, percent))


def test_jaccard_long(spark, monkeypatch):
    """Long texts that share a paragraph alone aren't tied; near copies among them are found, whatever the size of their blocks."""
    import random

    from tessera.llm import op9_jaccard

    draw, told = random.Random(11), {}
    common = [f"c{i}" for i in range(60)]
    texts = [[f"w{draw.random()}" for _ in range(2_000)] + common + [f"w{draw.random()}" for _ in range(2_000)] for _ in range(60)]
    for share, of in ((0.005, 0), (0.02, 1), (0.03, 2)):  # five words a change
        texts.append([f"n{draw.random()}" if draw.random() < share else w for w in texts[of]])
    texts += [texts[3][: 4 * len(texts[3]) // 5 + 2], texts[4][: 7 * len(texts[4]) // 10]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs, expected = spark.createDataFrame(rows, "doc_id long, text string"), brute_jaccard(rows, 5, 80)
    assert len({c for _, _, c in expected}) in range(60, 63)
    components = op9_jaccard.components

    def spy(edges, name):
        out = components(edges, name)
        told[name] = out.df.count()
        return out

    monkeypatch.setattr(op9_jaccard, "components", spy)
    for few in (None, 1, 1_000):
        if few:
            monkeypatch.setattr(op9_jaccard, "FEW", few)
        same(op9_jaccard.join(docs, 5, 80).select("doc_id", "n_shingles", "component_id"), expected)
        assert told["jaccard-maybe"] <= 10


def test_toxic(docs, spark):
    from tessera.llm import op7_toxic

    labels = spark.createDataFrame([(1, 1, 1), (2, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = op7_toxic.classify(docs, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in pairs(docs))
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_toxic_held_out(spark):
    from tessera.llm import op7_toxic

    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = op7_toxic.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in got)
    caught = [r.predicted for r in got if r.toxic == 1]
    assert right / len(got) > 0.97 and sum(caught) / len(caught) > 0.9


def test_toxic_fold():
    from tessera.llm.op7_toxic import Model, fold, hits

    assert fold("1d10t!") == "idiot" and fold("ІDІОТ") == "idiot" and fold("i.d.i.o.t") == "idiot" and fold("2024") == "" and fold("ïdïot,") == "idiot"
    model = Model({"trash ": 3.0, "idio": 2.0, "idiot ": 2.5}, frozenset({("white", "trash")}))
    automaton = model.automaton()
    assert hits(["an", "idiot", "trash"], automaton, frozenset()) == [(1, 2.5), (2, 3.0)]
    assert hits(["white", "trash", "idiots"], automaton, model.exceptions) == [(2, 2.0)]


def brute_decon(texts, items, size=8):
    """The rule by plain loops: every window of every item against every window of every text, by its words."""
    from tessera.llm import op10_decon

    def tokens(text):
        out, start = [], True
        for line in (text or "").split("\n"):
            start = True
            for w in line.split():
                bare, begins, start = op10_decon.clean(w), start, bool(re.search(r"[.!?:][^\w]*$", w))
                low = bare.lower()
                kind = "number" if op10_decon._NUMBER.fullmatch(low) or low in op10_decon._WORDS else "unit" if low in op10_decon.UNITS else None
                if not kind and not any(map(str.isalnum, bare)):
                    continue
                if not kind and not begins and len(bare) > 1 and bare[0].isupper() and bare[1:].islower():
                    kind = "name"
                out.append((f"<{kind}>" if kind else low, kind is not None, low))
        return out

    def windows(t):
        every = [t[p : p + size] for p in range(len(t) - size + 1)]
        return {p: tuple(x for x, _, _ in w) for p, w in enumerate(every) if sum(not slot for _, slot, _ in w) >= 4}

    def judge(text, item):
        t, i = tokens(text), tokens(item)
        own = windows(i)
        if len(i) < 3:
            return None
        if len(own) < 3:
            words = [x for _, _, x in i]
            return (1, "verbatim") if any([x for _, _, x in t[p : p + len(i)]] == words for p in range(len(t))) else None
        lines, best = {}, None
        for p, w in windows(t).items():
            for q, v in own.items():
                if w == v:
                    lines.setdefault(p - q, []).append(p)
        for shift, places in lines.items():
            pairs_ = {(i[p - shift][2], t[p][2]) for a in places for p in range(a, a + size) if t[p][1]}
            if len(places) >= 3 and len({x for x, _ in pairs_}) == len(pairs_) == len({y for _, y in pairs_}):
                best = max(best or (0, ""), (len(places), "verbatim" if all(x == y for x, y in pairs_) else "reparameterised"))
        return best

    out = []
    for d, text in texts:
        got = sorted((n, *hit) for n, item in items if (hit := judge(text, item)))
        if got:
            out.append((d, [n for n, _, _ in got], sum(n for _, n, _ in got), max(h for _, _, h in got)))
    return out


NUMBERS = "3 + 4 = 7 and 12 + 5 = 17 and 6 + 6 = 12"


def test_decon_rule(spark):
    """Repeated rows, rows without an id, short items and items of numbers, at any block size, against plain loops."""
    from tessera.llm import op10_decon

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items += [(1000, NUMBERS), (1001, "Why is grass green"), (1002, "Tiny item"), (1003, ""), (1004, None), (1005, items[1][1]), (1006, "Alice met Bob in Paris on 3 May with Carol and Dave")]
    a, b = items[1][1], items[2][1]
    texts = [(1, "x " + a + " y"), (1, "x " + a + " y"), (None, a), (None, a + " z " + b), (None, b), (2, f"we know that {NUMBERS} holds"), (3, "Heading\nWhy is grass green"), (4, "a Tiny item"), (5, None), (6, "")]
    texts += [(7, a[: len(a) // 2]), (8, a.upper()), (9, "then Alice met Bob in Paris on 3 May with Carol and Dave"), (10, "then Erin met Bob in Rome on 4 May with Carol and Fay")]
    texts += pairs(spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 3000"))
    want = sorted(map(str, brute_decon(texts, items)))
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert len(want) > 10
    for block in (10, 200, 1 << 21):
        got = sorted(str((r.doc_id, list(r.item_ids), r.n_windows, r.kind)) for r in op10_decon.contaminated(docs, bench, block_tokens=block).collect())
        assert got == want, block
        kept = op10_decon.without(docs, bench, block_tokens=block) if block > 10 else None
        assert kept is None or kept.count() == len(texts) - len(want)


def test_decon(docs, spark):
    from tessera.llm import op10_decon

    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = rows(op10_decon.contaminated(docs, bench))
    items = [(r.item_id, r.text) for r in bench.collect()]
    short = [(d, t) for d, t in pairs(docs) if len(t or "") < 3000]
    want = sorted(map(str, brute_decon(short, items)))
    ids = {d for d, _ in short}
    assert sorted(str((r[0], list(r[1]), r[2], r[3])) for r in got if r[0] in ids) == want
    kept = {r.doc_id for r in op10_decon.without(docs, bench).collect()}
    assert kept == {d for d, _ in pairs(docs)} - {r[0] for r in got}


def test_decon_slots(spark):
    from tessera.llm import op10_decon

    item = "A train leaves Boston at 3 pm and travels 120 miles before it meets Alice who walked 4 km from the station in Boston today"
    texts = [
        item,
        "so a train leaves Denver at 7 pm and travels 95 miles before it meets Bob who walked 12 km from the station in Denver today ok",
        "so a train leaves Denver at 7 pm and travels 95 miles before it meets Bob who walked 12 km from the station in Paris today ok",
        "nothing of the kind stands in this text about trains and miles",
    ]
    bench = spark.createDataFrame([(7, item), (8, None), (9, "too short")], "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.kind for r in op10_decon.contaminated(docs, bench).collect()}
    assert got == {0: "verbatim", 1: "reparameterised"}
    assert op10_decon.contaminated(docs, bench.limit(0)).count() == 0


def test_media(spark):
    """Copies with a border cut off, brighter or noisy are found; others and flat images are left alone."""
    from tessera.llm import op8_media

    draw = np.random.default_rng(3)
    images = [op8_media.resize(draw.random((14, 14)), 112, 112) * 200 for _ in range(12)]
    out = [(i, a) for i, a in enumerate(images)]
    out += [(100 + i, a[10:100, 6:104]) for i, a in enumerate(images[:4])]
    out += [(200 + i, a * 0.8 + 30) for i, a in enumerate(images[:4])]
    out += [(300 + i, a + draw.normal(0, 2, a.shape)) for i, a in enumerate(images[:4])]
    out += [(400, images[5]), (500, np.zeros((64, 64)))]
    rows_ = [(i, a.clip(0, 255).astype(np.uint8).tobytes(), a.shape[0], a.shape[1], i) for i, a in out] + [(600, None, 3, 3, 0), (601, None, 3, 3, 0), (602, b"abc", 9, 9, 0), (None, b"abc", 1, 3, 0)]
    docs = spark.createDataFrame([(i, None if p is None else bytearray(p), h, w, n) for i, p, h, w, n in rows_], "image_id long, pixels binary, height int, width int, node long")
    got = {r.image_id: r.class_id for r in op8_media.classes(docs).collect()}
    assert all(got[i] == (i % 100 if i < 400 else 5 if i == 400 else i) for i in got), got
    assert len(got) == len(rows_) - 1
    assert op8_media.classes(docs.limit(0)).count() == 0


def test_media_overlay(spark):
    """An image with a patch of stronger corners laid over it is still a copy of the one without."""
    from tessera.llm import op8_media

    draw = np.random.default_rng(9)
    plain = [100 + 80 * (op8_media.resize(draw.random((28, 28)), 224, 224) - 0.5) for _ in range(3)]
    over = [a.copy() for a in plain]
    for a in over:
        a[:88, :88] = 30 + 195 * op8_media.resize(draw.random((11, 11)), 88, 88)
    assert len(op8_media.describe(plain[0])[0]) > 4 * 24
    rows_ = [(i, bytearray(a.clip(0, 255).astype(np.uint8).tobytes()), 224, 224) for i, a in enumerate([*plain, *over])]
    images = spark.createDataFrame(rows_, "image_id long, pixels binary, height int, width int")
    assert {r.image_id: r.class_id for r in op8_media.classes(images).collect()} == {i: i % 3 for i in range(6)}


def test_media_hot_key(spark, monkeypatch):
    """Two copies whose only common key has an earlier, unrelated image first find each other, in chunks too."""
    from tessera.llm import op8_media

    draw = np.random.default_rng(4)
    bits, spots = draw.integers(0, 256, (20, 16), dtype=np.uint8), draw.random((20, 2)) * 400
    near = bits.copy()
    near[:, 4::2] ^= (1 << (np.arange(6) % 8)).astype(np.uint8)  # 6 bits, some in each word but the first
    other = np.concatenate([bits[:, :4], draw.integers(0, 256, (20, 12), dtype=np.uint8)], 1)
    images = [(other, draw.random((20, 2)) * 400), (bits, spots), (near, spots + 3)]
    rows_ = [(20 * i + k, i, *map(float, at[k]), 1.0, 0.5, *map(int, b[k].view("<i4"))) for i, (b, at) in enumerate(images) for k in range(20)]
    points = spark.createDataFrame(rows_, "point long, node long, x float, y float, scale float, angle float, d0 int, d1 int, d2 int, d3 int")
    for chunk in (1000, 1):
        monkeypatch.setattr(op8_media, "CHUNK", chunk)
        assert {r.node: r.label for r in op8_media.joined(points).df.collect()} == {1: 1, 2: 1}


def test_media_short_keys(spark):
    """Images with 20 common descriptors, each MEET bits apart and equal in no word, are found: 9 of 10 at least."""
    from tessera.llm import op8_media

    draw, rows_ = np.random.default_rng(8), []
    for pair in range(40):
        bits, spots = draw.integers(0, 2, (20, 128), dtype=np.uint8), draw.random((20, 2)) * 400
        far = bits.copy()
        for k in range(20):
            far[k, np.concatenate([draw.choice(32, n, replace=False) + 32 * w for w, n in enumerate((3, 3, 2, 2))])] ^= 1
        for side, b in enumerate((bits, far)):
            for at, words in zip(spots, np.packbits(b, axis=1).view("<i4")):
                rows_.append((len(rows_), 2 * pair + side, *map(float, at), 1.0, 0.5, *map(int, words)))
    points = spark.createDataFrame(rows_, "point long, node long, x float, y float, scale float, angle float, d0 int, d1 int, d2 int, d3 int")
    got = {r.node: r.label for r in op8_media.joined(points).df.collect()}
    assert sum(got.get(2 * i + 1) == 2 * i for i in range(40)) >= 36 and all(v // 2 == k // 2 for k, v in got.items())


def test_media_against_brute(spark):
    """Of the links that comparing all descriptors of all images gives between cropped, scaled and noisy copies, 0.9 at least are found."""
    from tessera.llm import op8_media

    draw, images = np.random.default_rng(6), []
    for a in (op8_media.resize(draw.random((14, 14)), 112, 112) * 200 for _ in range(4)):
        images += [x.clip(0, 255).astype(np.uint8) for x in (a, a[10:100, 6:104], op8_media.resize(a, 80, 80), a + draw.normal(0, 10, a.shape))]
    told = [op8_media.describe(a) for a in images]
    points = [(p.astype(np.float32), np.ascontiguousarray(b).view(np.uint64)) for p, b in told]
    links = {(i, j) for j in range(len(images)) for i in range(j) if op8_media.linked(points[i], points[j])}
    assert len(links) >= 12 and all(i // 4 == j // 4 for i, j in links)
    rows_ = [(i, bytearray(a.tobytes()), *a.shape) for i, a in enumerate(images)]
    got = {r.image_id: r.class_id for r in op8_media.classes(spark.createDataFrame(rows_, "image_id long, pixels binary, height int, width int")).collect()}
    assert sum(got[i] == got[j] for i, j in links) >= 0.9 * len(links)
    assert all(v // 4 == k // 4 for k, v in got.items())


def test_media_recall(spark):
    """Of the links that comparing all pairs of rendered vectors and edited copies gives, 0.9 at least are found, and no others."""
    from tessera.llm import op8_media

    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 100")
    images = op8_media.render(vectors)
    every = images.unionByName(op8_media.edited(images, 2)).collect()
    points = {}
    for r in every:
        p, b = op8_media.describe(np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width))
        points[r.image_id] = p.astype(np.float32), np.ascontiguousarray(b).view(np.uint64)
    ids = sorted(points)
    links = [(i, j) for j in ids for i in ids if i < j and op8_media.linked(points[i], points[j])]
    got = {r.image_id: r.class_id for r in op8_media.classes(spark.createDataFrame(every, images.schema)).collect()}
    assert len(got) == len(every) and len(links) >= 45
    assert sum(got[i] == got[j] for i, j in links) >= 0.9 * len(links)
    assert all(got[i] == got[-1 - i] for i, j in links if j == -1 - i and got[i] == got[j])
    copies = [i for i in ids if i < 0]
    assert sum(got[i] == got[-1 - i] for i in copies) >= 0.9 * len(copies) and len(set(got.values())) >= 95


def test_media_disk(spark):
    """Shuffle files hold the points once for a key that is being compared, not for all keys."""
    import threading
    from pathlib import Path

    import pyarrow as pa

    from tessera.llm import op8_media
    from tessera.llm.common import free

    draw, n = np.random.default_rng(9), 100_000
    words = draw.integers(-(2**31), 2**31, (n, 4))
    rows_ = pa.table({"point": np.arange(n), "node": np.arange(n) // 50, **{c: np.ones(n, np.float32) for c in ("x", "y", "scale", "angle")}, **{f"d{i}": words[:, i].astype(np.int32) for i in range(4)}})
    points = spark.createDataFrame(rows_).repartition(8).localCheckpoint()
    free(spark)
    folders = [Path(f.getPath()) for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    sizes, ended = [], threading.Event()

    def size(f):
        try:
            return f.stat().st_size
        except FileNotFoundError:
            return 0

    def sample():
        while not ended.wait(0.02):
            sizes.append(sum(size(f) for folder in folders for f in folder.rglob("shuffle_*.data")))

    watch = threading.Thread(target=sample)
    watch.start()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are too large for it
    try:
        assert op8_media.joined(points).df.count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        ended.set()
        watch.join()
    assert max(sizes) - sizes[0] < 190 * n


def near_points(images, points, flips, seed):
    """Images (spots, words) whose points are alike in pairs, a few bits apart, at unrelated places; each tenth is a copy of the one before."""
    draw = np.random.default_rng(seed)
    base, out = draw.integers(0, 2, (points, 128), dtype=np.uint8), []
    for i in range(images):
        bits, spots = base.copy(), draw.random((points, 2)) * 400
        for row in bits:
            row[draw.choice(128, flips, replace=False)] ^= 1
        spots = out[-1][0][:, :2] + 3 if i % 10 == 9 else spots
        out.append((np.concatenate([spots, np.ones((points, 1)), np.full((points, 1), 0.5)], 1).astype("<f4"), np.packbits(bits, axis=1).view("<i4")))
    return out


def test_media_blocks(monkeypatch):
    """Links in and between blocks join the same images as all pairs by plain loops, whatever is compared in one go."""
    from tessera.llm import op8_media

    told = near_points(40, 12, 5, 12)
    nodes = np.random.default_rng(2).permutation(40) * 10**16 - 10**17
    rows_ = [(int(n), np.concatenate([s.view(np.uint8), w.view(np.uint8)], 1).tobytes()) for n, (s, w) in zip(nodes, told)]
    images = {int(n): (s, w.view(np.uint64)) for n, (s, w) in zip(nodes, told)}
    masks = [np.array(m, "<i4").view(np.uint64) for m in op8_media._KEYS]

    def met(a, b):
        near = lambda x, y: any(((x & m) == (y & m)).all() for m in masks) and np.bitwise_count(x ^ y).sum() <= op8_media.MEET
        return sum(any(near(x, y) for y in images[b][1]) for x in images[a][1]) >= 2

    def parts(links):
        label = {n: n for n in images}
        for a, b in links:
            lo, hi = sorted((label[a], label[b]))
            label = {n: lo if x == hi else x for n, x in label.items()}
        return label

    order = sorted(images)
    expected = parts([(a, b) for i, a in enumerate(order) for b in order[i + 1 :] if met(a, b) and op8_media.linked(images[a], images[b])])
    assert len(set(expected.values())) < 40
    for chunk, meetings, piece in ((1 << 20, 1 << 21, 100_000), (1, 1, 1), (50, 30, 700)):
        monkeypatch.setattr(op8_media, "CHUNK", chunk), monkeypatch.setattr(op8_media, "MEETINGS", meetings), monkeypatch.setattr(op8_media, "SLICE_POINTS", piece)
        whole, left, right = op8_media._Block(rows_[:]), op8_media._Block(rows_[:17]), op8_media._Block(rows_[17:])
        assert parts(op8_media._links(whole, whole, {})) == expected
        assert parts([x for pair in ((left, left), (left, right), (right, right)) for x in op8_media._links(*pair, {})]) == expected
    assert parts(op8_media._links(whole, whole, {n: 7 for n in order})) == {n: n for n in order}


def test_media_linked():
    """Votes of mutually nearest points for one similarity, against plain loops, near the least number of votes."""
    import math

    from tessera.llm import op8_media

    def plain(p, q):
        far = [[int(np.bitwise_count(a ^ b).sum()) for b in q[1]] for a in p[1]]
        pairs = [(i, j) for i, row in enumerate(far) for j, d in enumerate(row) if d <= op8_media.DIFFER and d == min(row) and d == min(r[j] for r in far)]
        for grid in (0.0, 0.5):
            votes = {}
            for i, j in pairs:
                (x, y, scale, angle), (u, v, to_scale, to_angle) = map(float, p[0][i]), map(float, q[0][j])
                turn, grow = to_angle - angle, to_scale / scale
                dx, dy = u - grow * (math.cos(turn) * x - math.sin(turn) * y), v - grow * (math.sin(turn) * x + math.cos(turn) * y)
                cell = [math.floor(k / n + grid) for k, n in ((turn % (2 * math.pi), op8_media.ANGLE_BIN), (math.log2(grow), op8_media.SCALE_BIN), (dx, op8_media.PLACE_BIN), (dy, op8_media.PLACE_BIN))]
                votes.setdefault((cell[0] % 12, *cell[1:]), set()).add((math.floor(x / 2), math.floor(y / 2)))
            if any(len(v) >= op8_media.LEAST_VOTES for v in votes.values()):
                return True
        return False

    draw, said = np.random.default_rng(21), []
    for k in range(300):
        n = int(draw.integers(3, 20))
        words = draw.integers(0, 2**64, (n, 2), dtype=np.uint64)
        spots = np.concatenate([draw.random((n, 2)) * 60, 2.0 ** (draw.integers(0, 4, (n, 1)) / 2), draw.random((n, 1)) * 6], 1)
        same, moved = int(draw.integers(0, 9)), spots.copy()
        moved[:same] += [3, 2, 0, 0.2 * (k % 2)]
        moved[same:] = draw.permutation(moved[same:])
        if k % 3 == 0:
            words[1], spots[1, :2] = words[0], spots[0, :2]  # two points of one place have one vote
        p, q = (spots.astype("<f4"), words), (moved.astype("<f4"), words ^ (draw.random((n, 2)) < 0.5).astype(np.uint64))
        said.append(op8_media.linked(p, q))
        assert said[-1] == plain(p, q)
    assert 30 < sum(said) < 270


def test_media_meetings(spark):
    """Images that meet by the thousand and aren't copies leave no row for each pair in the shuffle files."""
    import threading
    from pathlib import Path

    from tessera.llm import op8_media
    from tessera.llm.common import free

    told = near_points(240, 20, 4, 5)
    rows_ = [(20 * i + k, i, *map(float, spots[k]), *map(int, words[k])) for i, (spots, words) in enumerate(told) for k in range(20)]
    points = spark.createDataFrame(rows_, "point long, node long, x float, y float, scale float, angle float, d0 int, d1 int, d2 int, d3 int").localCheckpoint()
    parts = op8_media.components(spark.createDataFrame([], "a long, b long"), "none").df
    free(spark)
    folders = [Path(f.getPath()) for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    sizes, ended = [], threading.Event()

    def size(f):
        try:
            return f.stat().st_size
        except FileNotFoundError:
            return 0

    def sample():
        while not ended.wait(0.02):
            sizes.append(sum(size(f) for folder in folders for f in folder.rglob("shuffle_*.data")))

    watch = threading.Thread(target=sample)
    watch.start()
    try:
        links = {(r.a, r.b) for r in op8_media._rest(points, parts).collect()}
    finally:
        ended.set()
        watch.join()
    assert {(i, i + 1) for i in range(8, 240, 10)} <= links
    assert max(sizes) - sizes[0] < 200 * len(rows_)


def test_components(spark):
    from tessera.llm.graph import components

    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 201), (201, 200), (5, 5)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), "t").df.collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[100 + i] == 100 for i in range(40)) and got[200] == got[201] == 200
    assert components(spark.createDataFrame([], "a long, b long"), "t").df.count() == 0


@pytest.fixture
def made(spark, monkeypatch):
    """How many files each table has that the operators on pairs write, with many partitions that nothing puts together."""
    from tessera.llm import graph, op8_media, op9_jaccard

    files, make = {}, graph.Written

    def written(df, name, *few):
        out = make(df, name, *few)
        files[name] = len(out.df.inputFiles())
        return out

    for module in (graph, op8_media, op9_jaccard):
        monkeypatch.setattr(module, "Written", written)
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield files
    for k, v in before.items():
        spark.conf.set(k, v)


def test_media_files(spark, made):
    """Tables and rounds have few files, however many partitions there are: a file made starts processes on some file systems."""
    from tessera.llm import op8_media

    draw = np.random.default_rng(4)
    images = [op8_media.resize(draw.random((9, 9)), 56, 56) * 200 for _ in range(40)]
    rows_ = [(i, bytearray(a.astype(np.uint8).tobytes()), 56, 56) for i, a in enumerate([*images, *(a * 0.8 + 30 for a in images)])]
    docs = spark.createDataFrame(rows_, "image_id long, pixels binary, height int, width int").repartition(40)
    got = {r.image_id: r.class_id for r in op8_media.classes(docs).collect()}
    assert all(got[i] == i % 40 for i in range(80)), got
    assert {"media-ids", "media-points", "media-tied", "media-close", "media-links", "media-labels"} <= set(made)
    assert max(made.values()) <= 16 and all(n == 1 for name, n in made.items() if re.search(r"-([2-9]|labels)$", name)), made


def test_jaccard_files(spark, made):
    """The same of the Jaccard join, whose buckets stay as many as there are partitions."""
    from tessera.llm import op9_jaccard

    rows_ = [(100 * g + i, " ".join([*(f"w{g}_{j}" for j in range(60)), f"end{i % 7}"])) for g in range(30) for i in range(9)]
    same(op9_jaccard.join(spark.createDataFrame(rows_, "doc_id long, text string"), 3, 90).select("doc_id", "n_shingles", "component_id"), brute_jaccard(rows_, 3, 90))
    assert {"jaccard-rows", "jaccard-met", "jaccard-maybe-labels", "jaccard-labels"} <= set(made)
    assert max(made.values()) <= 16 and all(n == 1 for name, n in made.items() if re.search(r"-([2-9]|labels)$", name)), made

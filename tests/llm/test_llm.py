"""The operators on hard cases and against plain loops."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from spanlake.llm import decontaminate, flac, language, mixing, neardup, pseudonyms, quality, queries, repeats, sharding, toxicity
from spanlake.llm import text as X

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, _row int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing columns."""
    words = [f"w{i}" for i in range(400)]
    base = " ".join(words[:200])
    rows = [(1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, base + " tail", "en", None), (4, None, None, "b"), (5, "", "en", "b"), (6, "...!!", "de", "b"),
            (None, base, "en", None), (7, " ".join(words * 40), "de", "c"), (8, "x" * 1_200_000, None, "c"), (9, "One two", "en", "c"), (10, "one TWO", "en", "c"), (11, "\x00 é ß   𝄞", "fr", "c")]
    return spark.createDataFrame([(*r, None, "s", 1) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def test_word_kernels():
    texts = ["a b  c", "", None, "d e", "É f\tg", " z "]
    buf, offsets = X.buffer_of(pa.array(texts))
    starts, ends, first = X.words(buf, offsets, X.SPACED)
    got = [[bytes(buf[s:e]) for s, e in zip(starts[a:b], ends[a:b], strict=True)] for a, b in zip(first, first[1:], strict=False)]
    assert got == [(t or "").encode().split() for t in texts]
    h = X.word_hashes(buf, starts, ends)
    assert len(set(h.tolist())) == len(h)
    assert X.word_hashes(*(lambda b: (b, np.array([1]), np.array([3])))(np.frombuffer(b"xab", np.uint8)))[0] == X.word_hashes(np.frombuffer(b"ab", np.uint8), np.array([0]), np.array([2]))[0]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), c.execute(queries.SQL[name]).df()
    key = lambda d: sorted(map(repr, d[sorted(d.columns)].astype(object).itertuples(index=False, name=None)))
    assert key(got.astype(want.dtypes.to_dict())) == key(want)


def test_near_duplicates_on_odd_rows(odd, none):
    got = {(r.doc_id, r.n_shingles): r for r in neardup.clusters(odd).collect()}
    assert {got[k].component_id for k in got if k[0] in (1, 2, 3)} == {1}
    assert got[(9, 1)].component_id == got[(10, 1)].component_id == 9
    assert got[(4, 0)].kept and got[(5, 0)].kept
    assert [r for r in got.values() if r.doc_id is None][0].component_id is None
    assert neardup.clusters(none).count() == 0
    assert sorted(r.doc_id or 0 for r in neardup.survivors(odd).collect()) == [0, 1, 4, 5, 6, 7, 8, 9, 11]


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a), (5, b), (5, a + " tail"), (5, a), (7, c), (2, c), (7, b + " z"), (7, "own words here"), (5, ""), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted(((r.doc_id or 0, r.text) for r in neardup.survivors(docs).collect()))
    assert [g for g in got if not g[1].startswith("a0 ")] == [(2, c), (5, ""), (5, b), (7, "own words here")]
    assert [g[0] for g in got if g[1].startswith("a0 ")] == [0, 5]


def test_components_with_a_hub(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 10)
    rng = np.random.default_rng(4)
    names = [f"{x:032x}" for x in rng.integers(0, 1 << 62, 300)]
    links = [(names[0], n) for n in names[1:120]] + [(names[i], names[i + 1]) for i in range(150, 200)] + [(names[5], names[160]), (names[210], names[211]), (names[211], names[210])]
    got = {r.cid: r.label for r in neardup.components(spark.createDataFrame(links, "x string, y string")).collect()}
    assert len(got) == 120 + 51 + 2 and len({got[n] for n in [*names[:120], *names[150:201]]}) == 1 and got[names[210]] == got[names[211]] != got[names[0]]


def exact_links(texts, k, percent):
    """Pairs of similar sets by their prefixes: every pair that is similar enough shares one of the rarest shingles."""
    sets = {}
    for i, t in texts.items():
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode()
        w = re.findall(rb"[^\x20\x09-\x0D]+", w)
        if w:
            sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1)))
    count = {}
    for s in set(sets.values()):
        for g in s:
            count[g] = count.get(g, 0) + 1
    index, links = {}, []
    for i, s in sets.items():
        first = sorted(s, key=lambda g: (count[g], g))[: len(s) - -(-percent * len(s) // 100) + 1]
        for j in {j for g in first for j in index.get(g, ())}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                links.append((i, j, 100 * both / (len(s) + len(sets[j]) - both)))
        for g in first:
            index.setdefault(g, []).append(i)
    return links


def test_recall_of_near_duplicates(spark):
    """Every exact link of the whole table at sf0.1, by band of similarity, joins its documents, and nothing else does."""
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    links = exact_links(texts, 4, 80)
    got = {r.doc_id: r.component_id for r in neardup.query(spark, folder).collect()}
    up = {i: i for i in texts}

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j, _ in links:
        a, b = sorted((root(i), root(j)))
        up[b] = a
    bands = {low: [got[i] == got[j] for i, j, s in links if low <= s < low + 5 or low == 95 and s == 100] for low in (80, 85, 90, 95)}
    assert all(len(v) and all(v) for v in bands.values()), {k: (len(v), sum(v)) for k, v in bands.items()}
    assert got == {i: root(i) for i in texts}
    print({k: len(v) for k, v in bands.items()})


def test_repeats_on_odd_rows(odd, none):
    got = {r.doc_id: r for r in repeats.dedup(odd, with_text=True).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == 200 and got[3].n_removed == 200 and got[3].kept == "tail"
    assert got[None].n_removed == 0 and got[4].n_words == 0 and got[4].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert repeats.dedup(none).count() == 0


def test_packed_hashes_come_back():
    rng = np.random.default_rng(1)
    for top in (1 << 24, 1 << 50):
        v = np.unique(rng.integers(0, top, 3000, dtype=np.uint64))
        f = rng.integers(1, 4, len(v)).astype(np.uint8)
        values, flags = repeats._decode(repeats._encode(v, f))
        assert (values[flags > 0] == v).all() and (flags[flags > 0] == f).all()


def brute(doc, items, window=10):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, found = norm(doc), set(), set()
    for name, t in items:
        x = norm(t)
        k = min(window, len(x))
        for i in range(len(x) - k + 1 if k else 0):
            for j in range(len(w) - k + 1):
                if w[j : j + k] == x[i : i + k]:
                    hit |= set(range(j, j + k))
                    found.add(name)
    return len(w), len(hit), sorted(found)


def test_automaton_against_loops():
    rng = np.random.default_rng(3)
    say = lambda n: " ".join(rng.choice(list("abc"), n))
    items = [(str(i), say(int(rng.integers(1, 14)))) for i in range(25)]
    docs = [say(int(rng.integers(0, 60))) for _ in range(40)] + [items[3][1] + " zz " + items[4][1].upper()]
    m = decontaminate.Matcher(items, 6)
    buf, offsets = X.buffer_of(pa.array(docs))
    buf = X.LOWER[buf]
    starts, ends, first = X.words(buf, offsets, X.ALNUM)
    hit = np.zeros(len(starts), bool)
    found = m.find(X.word_keys(buf, starts, ends), first, hit)
    for d, t in enumerate(docs):
        assert (first[d + 1] - first[d], hit[first[d] : first[d + 1]].sum(), sorted(found.get(d, ()))) == brute(t, items, 6)


def test_automata_are_small():
    """Words in the order of a text, as arrays: some tens of bytes a word."""
    rng = np.random.default_rng(5)
    rows = [(str(i), " ".join(rng.choice([f"v{j}" for j in range(3000)], 60))) for i in range(800)]
    m = decontaminate.Matcher(rows)
    held = sum(v.nbytes for v in vars(m.automaton).values() if isinstance(v, np.ndarray)) + m.pairs.nbytes + m.vocabulary.nbytes
    assert held < 120 * 800 * 60


def test_decontamination_on_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(100, 130))), (2, None), (3, "")], "item_id bigint, text string")
    got = {r.doc_id: r for r in decontaminate.report(decontaminate.occurrences(odd, bench, shard_bytes=10)).collect()}
    assert got[1].n_hit == 30 and got[7].n_hit == 1200 and got[4].n_words == 0 and not got[9].contaminated
    assert decontaminate.occurrences(none, bench).count() == 0
    kept = {r.doc_id: r for r in decontaminate.cut(odd, bench).collect()}
    assert "w115" not in kept[1].text and kept[9].text == "One two" and kept[4].text is None


def test_cut_does_not_depend_on_shards(spark):
    w = [f"w{i}" for i in range(200)]
    say = lambda a, b: " ".join(w[a:b])
    bench = spark.createDataFrame([(1, say(50, 62)), (2, say(56, 70)), (3, say(100, 140)), (4, say(145, 170)), (5, say(40, 45) + " " + say(75, 80))], "item_id bigint, text string")
    # overlapping passages; two that cover 65 of 100 words; words that only meet after a cut
    docs = spark.createDataFrame([(1, say(0, 90)), (2, say(100, 140) + " " + say(145, 170) + " " + say(0, 35)), (3, say(40, 45) + " " + say(50, 62) + " " + say(75, 95)), (4, None), (5, "")], "doc_id bigint, text string")
    want = {1: say(0, 50) + "  " + say(70, 90), 3: say(40, 45) + "  " + say(75, 95), 4: None, 5: ""}
    for size in (1, 10, 1 << 20):
        assert {r.doc_id: r.text for r in decontaminate.cut(docs, bench, shard_bytes=size).collect()} == want


def test_mix(spark, odd, none):
    rows = mixing.mix(odd).collect()
    assert all(r.taken <= 2 * r["size"] for r in rows) and len(rows) == odd.count()
    assert sum(r.taken for r in rows) == pytest.approx(1.5 * sum(r["size"] for r in rows), rel=0.02)
    assert mixing.mix(none).count() == 0
    assert mixing.mixed(odd).columns == odd.columns
    lone = spark.createDataFrame([(i, f"w{i} " * 3, "only" if i % 4 else "other") for i in range(40)], "doc_id bigint, text string, source string")
    firsts = sorted((s, r.doc_id) for r in mixing.mix(lone).collect() for s, n in zip(r.slots, r.passes, strict=True) if 2 * n >= r["size"])
    assert len(firsts) > 40 and [r.doc_id for r in mixing.mixed(lone).collect()] == [i for _, i in firsts]
    nulls = spark.range(30).select(F.lit(None).cast("string").alias("text"), F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    assert all(r["size"] == r.taken == 0 and r.slot is None for r in mixing.mix(nulls).collect()) and mixing.mixed(nulls).count() == 0
    i = np.arange(300)
    x, u = mixing._reverse(i), 1 << 46
    assert mixing._earlier(i, np.full(300, u)).tolist() == [int((x[:k] < u).sum()) for k in i]


def test_small_sources_get_their_words_in_large_mixes(spark, monkeypatch):
    assert mixing.words_due([], 0)[0].tolist() == []
    shares = [3e9, 300.0, 4e9, 1000.4, 3000.0, 5e8]
    total = sum(shares)
    due, has = mixing.words_due(shares, int(round(total / 1024)))
    assert due.tolist()[1:5:2] + [due.tolist()[4]] == [300, 1000, 3000] and has.sum() == round(total / 1024)
    assert all(abs(n - t) <= max(0.5, 0.005 * t) for n, t in zip(due.tolist(), shares, strict=True))
    monkeypatch.setattr(mixing, "SLOTS", 64)  # slots of many words on a small table
    text = F.concat_ws(" ", F.array_repeat(F.lit("w"), 60))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), text.alias("text"), F.when(F.col("id") < 8, F.concat(F.lit("s"), F.col("id"))).otherwise(F.concat(F.lit("z"), F.col("id") % 2)).alias("source"))
    sums = mixing.mix(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.count("*").alias("n")).collect()
    alone = [r for r in sums if r.source_size == 60]
    assert sum(r.n for r in alone) == 8 and all(r.taken == round(r.target) * r.n for r in alone)
    assert mixing.mixed(docs).where("source like 's%'").select("source").distinct().count() == 8


def test_shards_move_into_the_new_one_only(spark, none):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    rows = sharding.shard(docs, 40).collect()
    assert all(r.grown_shard in (r.shard, 40) for r in rows)
    for s in range(40):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own))) and 50 < len(own) < 160
    assert sharding.shard(none, keep=tuple(none.columns)).columns[:2] == ["doc_id", "text"]


def test_every_shard_takes_rows_only_into_itself(spark):
    docs = spark.range(400).select(F.col("id").cast("string").alias("key")).coalesce(1)
    for a in range(1, 51, 10):
        rows = docs.select(*[sharding.place(F.col("key"), sharding.tree_of(n)).alias(str(n)) for n in range(a, a + 11)]).collect()
        for n in range(a, a + 10):
            assert all(r[str(n + 1)] in (r[str(n)], n) and 0 <= r[str(n)] < n for r in rows), n
            assert any(r[str(n + 1)] == n for r in rows)


def test_weights_and_closed_shards(spark):
    docs = spark.range(6000).select(F.col("id").cast("string").alias("key"))
    trees = {"even": sharding.tree_of(20), "drained": sharding.tree_of(20, {3: 0.0}), "heavy": sharding.tree_of(20, {17: 3.0})}
    rows = docs.select(*[sharding.place(F.col("key"), t).alias(n) for n, t in trees.items()]).collect()
    assert all(r.drained != 3 and (r.drained == r.even or r.even == 3) for r in rows)
    heavy = sum(r.heavy == 17 for r in rows) / len(rows)
    assert abs(heavy - 3 / 22) < 0.02 and all(abs(sum(r.even == s for r in rows) / len(rows) - 1 / 20) < 0.02 for s in range(20))
    with pytest.raises(ValueError):
        sharding.tree_of(2, {0: 0.0, 1: 0.0})


def test_shards_of_odd_rows(odd):
    rows = sharding.shard(odd, 3, keep=tuple(odd.columns)).collect()
    assert len(rows) == odd.count() and {"in_size", "in_text"} & set(rows[0].asDict()) == {"in_size"}
    null = next(r for r in rows if r.doc_id == 4)
    assert null["size"] == 16 and null.text_crc32 is None and len({r.shard for r in rows if r.doc_id == 2}) == 1
    for s in range(3):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))


def test_flac_round_trip_and_checks(odd, none):
    rng = np.random.default_rng(2)
    blocks = [bytes(64), b"abc " * 700, rng.integers(0, 256, 3000).astype(np.uint8).tobytes(), bytes(range(256)) * 9]
    buf, edge = flac.padded(np.frombuffer(b"".join(blocks), np.uint8), np.cumsum([0] + [len(b) for b in blocks]))
    streams = flac.encode(buf, edge)
    for i, (samples, parts) in enumerate(flac.decode(streams)):
        assert ((samples.astype(np.int16) + 128).astype(np.uint8) == buf[edge[i] : edge[i + 1]]).all()
        assert parts[0][0] == 0 and sum(n for _, n in parts) == len(samples)
    for at in (-5, len(streams[1]) // 2):
        broken = bytearray(streams[1])
        broken[at] ^= 4
        with pytest.raises(ValueError):
            flac.decode([bytes(broken)])
    for n in range(len(streams[1]) - 40, len(streams[1])):
        with pytest.raises(ValueError):
            flac.decode([streams[1][:n]])
    got = {r.doc_id: r for r in flac.digest(odd.where("doc_id is not null")).collect()}
    assert got[4].payload_bytes == 64 and got[1].media_sha256 == got[2].media_sha256
    whole = " ".join([f"w{i}" for i in range(400)] * 40).encode()
    assert got[7].payload_sha256 == hashlib.sha256(whole + bytes(-len(whole) % 64)).hexdigest()
    assert flac.digest(none).count() == 0 and flac.pcm(flac.media(odd)).where("doc_id = 9").first().n_samples == 64


def test_flac_against_plain_loops(spark, monkeypatch):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in flac.query(spark, SF).collect()}
    assert rows.keys() == texts.keys()
    for i, t in texts.items():
        payload, r = t + bytes(64 if not t else -len(t) % 64), rows[i]
        x = [b - 128 for b in payload]
        turns = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))
        feature = f"blocks={-(-len(x) // 1024)};peak={max(map(abs, x))};power={sum(v * v for v in x)};turns={turns}"
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) == (len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), feature)
    media = {r.doc_id: r.media for r in flac.media(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert all((rows[i].media_bytes, rows[i].media_sha256) == (len(m), hashlib.sha256(m).hexdigest()) for i, m in media.items())
    monkeypatch.setattr(flac, "GROUP", 3)  # groups change nothing
    edge = np.cumsum([0] + [len(t) for t in list(texts.values())[:20]])
    buf, edge = flac.padded(np.frombuffer(b"".join(list(texts.values())[:20]), np.uint8), edge)
    assert flac.encode(buf, edge) == [media[i] for i in list(texts)[:20]]


def test_linear_predictor_with_partitions_and_escape():
    """A frame written by hand: order-1 predictor with coefficient 1, two partitions, the second escaped."""
    bits = "0" + "100000" + "0" + f"{5:08b}" + f"{1:04b}" + f"{0:05b}" + "01" + "00" + "0001"
    bits += f"{2:04b}" + "".join("0" * (u >> 2) + "1" + f"{u & 3:02b}" for u in [2] * 7)
    bits += "1111" + f"{3:05b}" + "001" * 8
    bits += "0" * (-len(bits) % 8)
    head = b"\xff\xf8\x60\x02\x00\x0f"
    frame = head + bytes([flac.crc8(head)]) + int(bits, 2).to_bytes(len(bits) // 8, "big")
    frame += int(flac.crc16(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0]).to_bytes(2, "big")
    samples, n, end = flac.decode_frames(frame, [0], [8])
    assert n[0] == 16 and end[0] == len(frame) and samples[0].tolist() == list(range(5, 21))


KEY = b"test"


def hide(text, back=False):
    return pseudonyms.hide(text, KEY, back)


def test_pseudonyms(odd, none):
    text = "mail ana.b7@x.org, card 4111 1111 1111 1111, not 4111111111111112, ip 10.0.0.1, on 2024-02-29, call +1 (212) 555-0100, ssn 123-45-6789, iban GB82 WEST 1234 5698 7654 32 token = \"abcdef0123456789\""
    out, n = hide(text)
    assert n == dict.fromkeys(pseudonyms.KINDS, 1) and "4111111111111112" in out
    for gone in ("ana.b7", "4111 1111", "10.0.0.1", "2024-02-29", "555-0100", "123-45-6789", "1234 5698", "abcdef0123456789"):
        assert gone not in out
    assert hide(out, back=True)[0] == text and hide(text)[0] == out
    p = pseudonyms.Permutation(1000, b"k", "t")
    image = [p.forward(i) for i in range(1000)]
    assert sorted(image) == list(range(1000)) and all(p.inverse(y) == i != y for i, y in enumerate(image))
    assert pseudonyms.pseudonymise(odd, KEY).where("doc_id = 4").first().text is None and pseudonyms.pseudonymise(none, KEY).count() == 0


def all_values(text):
    """Valid values of the formats by trying every start and end."""
    end = lambda form, b: re.compile(form + f"(?=.{{{len(text) - b}}}\\Z)")
    tries = [(a, b, kind, end(form, b)) for kind, form in pseudonyms._FORMS.items() for b in range(6, len(text) + 1) for a in range(b)]
    found = {(a, b, kind) for a, b, kind, form in tries if form.match(text, a) and pseudonyms.valid(kind, text[a:b])}
    return {f for f in found if f[2] != "phone" or not any(a < f[1] < b for a, b, kind in found if kind == "ip")}


def test_values_beside_numbers():
    gone = [("+1 (826) 555-4081 190.137.223.204", ["555-4081", "190.137.223.204"]), ("card 4111 1111 1111 1111 12/27", ["4111 1111 1111 1111"]), ("4111111111111111 42", ["4111111111111111"]), ("7 4111111111111111", ["4111111111111111"]),
            ("ssn 123-45-6789 1234", ["123-45-6789"]), ("on 2024-02-29 12345", ["2024-02-29"]), ("ES91 2100 0418 4502 0005 1332 2024", ["ES91 2100 0418 4502 0005 1332"]), ("+1 8265 101.102.1.2", ["101.102.1.2"])]
    for text, values in gone:
        out = hide(text)[0]
        assert len(values) <= sum(hide(text)[1].values()) and not any(v in out for v in values), text
    gone = [("password = correcthorsebatterystaple", "correct", "secret"), ("card 4111 1111 1111 1111 123 cvv", "4111 1111", "card"), ("GB00 4111 1111 1111 1111", "4111 1111", "card"), ("on 12/31/1999 it", "12/31/1999", "date"),
            ("token: " + "aB3" * 60 + ".x9y8.zz", "aB3aB3", "secret"), ("mail " + "a.b" * 50 + "@x.org", "a.ba.b", "email"), ("card ٤١١١ ١١١١ ١١١١ ١١١١", "١١١١ ١١١١", "card"), ("ip ١٠.٢٠.٣٠.٤٠", "٢٠.٣٠", "ip")]
    for text, value, kind in gone:
        out, n = hide(text)
        assert n == {**dict.fromkeys(pseudonyms.KINDS, 0), kind: 1} and value not in out and hide(out, back=True)[0] == text, text
    late = {pseudonyms.pseudonym("date", f"{m:02}/{d}/2001", KEY) for m in range(1, 13) for d in range(13, 29)}
    assert len(late) == 12 * 16 and all(pseudonyms._date(x)[1] for x in late)
    values = ["+1 (826) 555-4081", "190.137.223.204", "4111 1111 1111 1111", "4111111111111111", "123-45-6789", "2024-02-29", "GB82 WEST 1234 5698 7654 32", "212-555-0100", "42", "1234", "12/27"]
    for a in values:
        for b in values:
            text = f"{a} {b}"
            found = pseudonyms.find(text)
            assert set(found) == all_values(text) and len(set(found)) == len(found), text
            taken = pseudonyms.choose(text, found)
            assert all(x[1] <= y[0] for x, y in zip(taken, taken[1:], strict=False)), text
            sets = [[]]
            for f in found:
                sets += [[*s, f] for s in sets if not s or s[-1][1] <= f[0]]
            assert sum(y - x for x, y, _ in taken) == max(sum(y - x for x, y, _ in s) for s in sets), text


def test_language(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in language.query(spark, SF).collect()}
    want = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i in want if got[i].held_out]
    assert held and np.mean([got[i].lang_pred == want[i] for i in held]) > 0.9
    some = {r.doc_id: r for r in language.predict(odd, {"en": b"one two three", "de": b"eins zwei drei"}).collect()}
    assert some[4].lang_pred == some[6].lang_pred == "und" and some[9].lang_pred == "en"
    assert language.normalise("½ 3²") == language.normalise("\u0301 7") == b"" and language.normalise("हिन्दी, É!") == "हिन्दी é".encode()
    held = language.dictionaries(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)

    def bytes_of(text, name):  # a plain loop with a fresh encoder for each piece
        body, total = b" " + language.normalise(text) + b" ", 0
        for i in range(0, len(body), language.PIECE):
            known = zstandard.ZstdCompressionDict(held[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=language.LEVEL)
            total += len(zstandard.ZstdCompressor(dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False).compress(body[i : i + language.PIECE]))
        return total

    for r in docs.where("doc_id % 5 = 0").collect():
        best = min(held, key=lambda name: bytes_of(r.text, name)) if r.text and language.normalise(r.text) else "und"
        assert got[r.doc_id].lang_pred == best
    assert language.predict(odd, {}).where("lang_pred <> 'und'").count() == 0 and language.dictionaries(none, F.lit(True)) == {}


def test_quality(spark, odd, none):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # only a pair tells
    s = quality.fit(x, y).score(x)
    assert np.mean((s >= 0.5) == (y > 0)) > 0.9
    model = quality.fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0))
    got = quality.score(odd, model, odd.columns)
    assert got.count() == odd.count() and got.columns == [*odd.columns, "_score"] and got.first()._score == 0.5
    assert quality.score(none, model, ["doc_id"]).count() == 0


def test_toxicity_gradients_and_learning(odd, none):
    rng = np.random.default_rng(1)
    say = lambda bad: " ".join([*rng.choice([f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)], 90), *(["vile", "scum"] * 2 if bad else [])])
    y = np.array([i % 3 == 0 for i in range(150)], float)
    net = toxicity.train(pa.array([say(v) for v in y]), y, np.ones(150))
    buf, offsets = X.buffer_of(pa.array([say(True), say(False), say(True).upper(), None, ""]))
    s = net.score(buf, offsets)
    assert s[0] > 0.5 > s[1] and s[2] > 0.5 and ((s >= 0) & (s <= 1)).all()
    ids, n_chars = rng.integers(0, 20, (6, 4)), rng.integers(1, 7, 24)
    chars = rng.integers(0, toxicity.BUCKETS, n_chars.sum())
    mask, t = np.arange(6)[:, None] < np.array([6, 4, 1, 5]), np.array([1, 0, 1, 0], np.float32)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        p = net.p
        x = net.inputs(ids, chars, n_chars)
        states = np.concatenate([net.layer(x @ p[f"w{d}"] + p[f"c{d}"], mask, d) for d in "fb"], axis=2)
        z = net.pool(states, mask)[3]
        return float(np.mean(np.logaddexp(0, z) - t * z))

    g = net._loss(ids, chars, n_chars, mask, t)
    for name, at in (("uf", (1, 2)), ("wb", (0, 20)), ("a", (3, 1)), ("v", (2,)), ("char", (int(chars[0]), 1)), ("cb", (9,))):
        old = net.p[name][at]
        net.p[name][at] = old + 1e-2
        up = loss()
        net.p[name][at] = old - 1e-2
        down = loss()
        net.p[name][at] = old
        assert g[name][at] == pytest.approx((up - down) / 2e-2, abs=2e-3)
    w = toxicity.words_of(*X.buffer_of(pa.array(["abX é", "q"])))
    code = lambda a, b, c: (((a << 16 | b << 8 | c) * 0x9E3779B1) & 0xFFFFFFFF) >> 20
    want = [code(0, 97, 98), code(97, 98, 120), code(98, 120, 0), code(0, 0xC3, 0xA9), code(0xC3, 0xA9, 0), code(0, 113, 0)]
    assert w.chars.tolist() == want and w.chars_of.tolist() == [0, 3, 5, 6] and w.ragged(np.array([2, 0]))[0].tolist() == [want[5], *want[:3]]
    many = pa.chunked_array([pa.array([say(True), None, "", "é"] * 900), pa.array(["abX é", "q"])])
    a, b = toxicity.all_words(many), toxicity.words_of(*X.buffer_of(many))
    assert all((getattr(a, k) == getattr(b, k)).all() for k in ("hashes", "chars", "chars_of", "first"))
    assert toxicity.score(odd, net).count() == odd.count() and toxicity.score(none, net).count() == 0
    assert toxicity.train(pa.array([], pa.string()), np.zeros(0), np.zeros(0)).prior == 0.0


def test_quality_against_plain_loops(spark):
    """Each text alone, its tables looked up one by one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    got = {r.doc_id: r for r in quality.query(spark, SF).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        x = quality.features(*X.buffer_of(pa.array([r.text], pa.string())))[0]
        total = model.base + sum(t[sum(c <= v for c in cut)] for cut, t, v in zip(model.cuts, model.tables, x, strict=True))
        total += sum(t[sum(c <= x[i] for c in model.coarse[i])][sum(c <= x[j] for c in model.coarse[j])] for i, j, t in model.pairs)
        assert got[r.doc_id].score == pytest.approx(1 / (1 + np.exp(-total))) and got[r.doc_id].predicted == (got[r.doc_id].score >= 0.5)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def mix_by_loops(rows):
    """Documents as often as the mix has them, for tables of few words, whose slots hold one word: (id, text, source)."""
    words = {(i, t): len(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t, _ in rows}
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s))
    size = {s: sum(words[i, t] for i, t, z in rows if z == s) for s in names}
    weight, total = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, 1.5 * sum(size.values())
    target, open_ = {}, set(names)
    while True:  # shares above twice the size go back
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[z] for z in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s]}
        if not over:
            break
        target |= {s: 2.0 * size[s] for s in over}
        open_ -= over
    target |= share
    ends, at = [], 0.0
    for s in names:
        at += target[s]
        ends.append(int(at / sum(target.values()) * 2.0**48))
    ends[-1] = 1 << 48
    slots = [0] * len(names)
    for i in range(round(sum(target.values()))):
        point = int(f"{i:048b}"[::-1], 2)
        slots[next(k for k, e in enumerate(ends) if point < e)] += 1
    out = []
    for k, s in enumerate(names):
        due, at = round(target[s]) if target[s] < 1024 else slots[k], 0
        own = [(i, t) for i, t, z in rows if z == s]
        own.sort(key=lambda r: hashlib.md5(f"mix-1:{r[0]}:{'null' if r[1] is None else hashlib.md5(r[1].encode()).hexdigest()}".encode()).hexdigest())
        for _ in range(2):
            for r in own:
                n = words[r]
                if n and 2 * max(0, min(n, due - at)) >= n:
                    out.append(r[0])
                at += n
    return sorted(out)


def test_pipeline_stages_against_loops(spark):
    """Each stage on its own input, against plain loops over all rows."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    given, names = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        rows = [(r.doc_id, r.text, r.source) for r in given.collect()]
        out = stage(spark, given, SF)
        out = corpus_pipeline.stash(out, f"test-{name}") if name != "sharding" else out
        got = out.collect()
        if name == "quality":
            model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            want = sorted(i for i, t, _ in rows if model.score(quality.features(*X.buffer_of(pa.array([t], pa.string()))))[0] >= 0.5)
            assert sorted(r.doc_id for r in got) == want and 100 < len(want) < len(rows)
        elif name == "near_duplicates":
            group = {i: i for i, _, _ in rows}
            for i, j, _ in exact_links({i: t for i, t, _ in rows}, 5, 80):
                a, b = sorted((group[i], group[j]))
                group = {k: a if v == b else v for k, v in group.items()}
            assert sorted(r.doc_id for r in got) == sorted(set(group.values())) and len(got) < len(rows)
        elif name == "decontamination":
            items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            found = {i: brute(t, items) for i, t, _ in rows}
            assert sorted(r.doc_id for r in got) == sorted(i for i, (n, hit, _) in found.items() if 2 * hit <= n)
            assert {r.doc_id for r in got if r.text != dict((i, t) for i, t, _ in rows)[r.doc_id]} == {r.doc_id for r in got if found[r.doc_id][1]}
            assert all(brute(r.text, items)[1] == 0 and r.n_chars == len(r.text) for r in got)
        elif name == "mixing":
            assert sorted(r.doc_id for r in got) == mix_by_loops(rows)
        else:
            draw = lambda key, child, w: -np.log((int(hashlib.md5(f"{key}|{child}".encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48)) / w
            for r in got:
                region = min(range(5), key=lambda g: draw(r.doc_id, f"region{g}", 8))
                rack = min((2 * region, 2 * region + 1), key=lambda k: draw(r.doc_id, f"rack{k}", 4))
                assert r.shard == min(range(4 * rack, 4 * rack + 4), key=lambda s: draw(r.doc_id, f"shard{s}", 1)) and r.grown_shard in (r.shard, 40)
            assert sorted(r.doc_id for r in got) == sorted(i for i, _, _ in rows)
            assert all(sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got))) for s in range(40))
        assert out.columns[: len(names)] == names
        given = out


def test_pipeline_on_odd_tables(spark, odd, none, tmp_path):
    import corpus_pipeline

    bench = "item_id bigint, text string"
    for name, table, items in (("empty", none, []), ("odd", odd, [(1, " ".join(f"w{i}" for i in range(100, 130))), (2, None)])):
        folder = str(tmp_path / name)
        table.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame(items, bench).write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        assert (len(got) > 0) == (name == "odd") and all("w115" not in (r.text or "") for r in got)


def test_regular_words_do_not_collide(spark):
    """Thue-Morse words and their complements are equal to any sum of powers modulo 2^64."""
    tail = " ".join(f"t{i}" for i in range(12))
    for size in (1024, 2048, 4096):
        bits = [bin(i).count("1") & 1 for i in range(size)]
        pair = ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]
        buf = np.frombuffer("".join(pair).encode(), np.uint8)
        assert len(set(X.word_keys(buf, np.array([0, size]), np.array([size, 2 * size])).tolist())) == 2
        docs = spark.createDataFrame([(i, f"{w} {tail}") for i, w in enumerate(pair)], "doc_id bigint, text string")
        assert {r.n_removed for r in repeats.dedup(docs).collect()} == {0}
        short = spark.createDataFrame([(i, w) for i, w in enumerate(pair)], "doc_id bigint, text string")
        assert [r.kept for r in neardup.clusters(short).collect()] == [True, True]
        items = spark.createDataFrame([("x", pair[0])], "item_id string, text string")
        assert {r.doc_id: r.n_hit for r in decontaminate.report(decontaminate.occurrences(short, items)).collect()} == {0: 1, 1: 0}


def test_word_keys_against_loops():
    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in [*range(1, 80), 200, 5000] for _ in range(4)]
    buf, ends = np.frombuffer(b" ".join(words), np.uint8), np.cumsum([len(w) + 1 for w in words]) - 1
    got = X.word_keys(buf, ends - [len(w) for w in words], ends)
    alone = [X.word_keys(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0] for w in words]
    assert got.tolist() == [int(x) for x in alone] and len(set(got.tolist())) == len(set(words))


def test_largest_doc_id(spark):
    w = " ".join(f"w{i}" for i in range(30))
    top = (1 << 63) - 1
    got = {r.doc_id: r.n_removed for r in repeats.dedup(spark.createDataFrame([(top, w), (3, w), (None, w)], "doc_id bigint, text string")).collect()}
    assert got == {top: 30, 3: 0, None: got[None]}


def test_addresses_of_many_scripts():
    locals_ = ["иван", "王小明", "łş", "елена.petrova", "Łukasz.Śliwa", "αλέξης", "דוד", "محمد", "たろう", "김철수", "ณัฐ", "ðþ", "x" * 90 + "ж" * 90]
    key = b"k" * 100
    for name in locals_:
        text = f"write to {name}@example.com now"
        new, counts = pseudonyms.hide(text, key)
        assert counts["email"] == 1 and new != text, name
        old, other = name.split("."), new.removeprefix("write to ").removesuffix("@example.com now").split(".")
        assert len(old) == len(other) and not any(a in new for a in old if len(a) > 1)
        assert pseudonyms.hide(new, key, back=True)[0] == text
    assert pseudonyms.hide("to _@example.com now", key) == ("to _@example.com now", dict.fromkeys(pseudonyms.KINDS, 0))
    assert pseudonyms.hide("иван@example.com", key)[0] != pseudonyms.hide("иван@example.com", b"k" * 101)[0]


def test_a_repeated_id_counts_once_in_samples(spark):
    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(2, "other words here"), (3, None)], "doc_id bigint, text string"))
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 0, 0), (3, 0, 1)], "doc_id bigint, quality int, toxic int")
    rows = sorted(map(tuple, quality.labelled(docs, labels, "quality", F.lit(True), 100).collect()))
    assert rows == [(1, "some words 0", 1), (2, "other words here", 0), (3, None, 0)]
    texts, y, _ = toxicity.sample(docs, labels, F.lit(True))
    assert texts.to_pylist() == ["some words 0", "other words here", None] and y.tolist() == [1, 0, 1]
    texts, _, _ = toxicity.sample(docs, labels, F.lit(True), budget=1)
    assert len(texts) == 1


def test_flac_frames_of_all_kinds(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect() if r.text]
    rng = np.random.default_rng(1)
    raw = [t.encode() for t in texts] + [bytes(5000), bytes(rng.integers(0, 256, 9000, dtype=np.uint8)), b"a" * 2048 + b"b", bytes([0, 255] * 3000)]
    raw += [(np.sin(np.arange(20_000) / w) * 100 + 128).astype(np.uint8).tobytes() for w in (3, 9, 70)] + [(128 + 100 * (np.arange(6000) // 128 % 2) * rng.standard_normal(6000)).clip(0, 255).astype(np.uint8).tobytes()]
    buf, edge = flac.padded(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])])
    streams, kinds, parts = flac.encode(buf, edge), set(), set()
    for (samples, _), a, z in zip(flac.decode(streams), edge, edge[1:], strict=False):
        assert ((samples.astype(np.int16) + 128).astype(np.uint8) == buf[a:z]).all()
    for stream in streams:
        h = flac.Stream(stream)
        for _, at, n in h.points:
            sub, _, _ = flac._frame_head(stream, h.start + at)
            kind = stream[sub] >> 1 & 63
            kinds.add(kind)
            if kind >= 8:
                bit = sub * 8 + 8 + 8 * (kind - 8 if kind < 32 else flac.TAPS) + (0 if kind < 32 else 9 + flac.PRECISION * flac.TAPS)
                parts.add(int.from_bytes(stream[bit >> 3 : (bit >> 3) + 2], "big") >> (16 - (bit & 7) - 6) & 15)
    assert kinds == {0, 1, 8, 9, 10, 31 + flac.TAPS} and parts == {0, 3}


def test_a_frame_must_be_the_one_its_seek_point_says():
    buf, edge = flac.padded(np.frombuffer(b"The quick brown fox. " * 200, np.uint8), np.array([0, 4200]))
    stream = bytearray(flac.encode(buf, edge)[0])
    h = flac.Stream(bytes(stream))
    at = h.start - 18 * len(h.points)
    stream[at + 8 : at + 16], stream[at + 26 : at + 34] = stream[at + 26 : at + 34], stream[at + 8 : at + 16]
    with pytest.raises(ValueError, match="not the one"):
        flac.decode([bytes(stream)])


def test_passes_of_a_large_benchmark(spark, odd, monkeypatch):
    """Many shards: each pass is a stage of its own with one Python node, and the result is that of one automaton."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    key = lambda d: sorted(map(repr, map(tuple, d.collect())))
    one = key(decontaminate.report(decontaminate.occurrences(docs, items))), key(decontaminate.cut(docs, items)), key(decontaminate.report(decontaminate.occurrences(odd, items)))
    monkeypatch.setattr(decontaminate, "PASS", 2)
    found = decontaminate.occurrences(docs, items, shard_bytes=3000)
    assert key(decontaminate.report(found)) == one[0] and found._jdf.queryExecution().toString().count("MapInArrow") <= 4 * 2
    assert key(decontaminate.cut(docs, items, shard_bytes=3000)) == one[1]
    assert key(decontaminate.report(decontaminate.occurrences(odd, items, shard_bytes=3000))) == one[2]

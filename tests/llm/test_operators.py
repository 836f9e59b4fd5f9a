"""Each operator against brute force on a small table with every awkward row: nulls, empties, ties, repeats, long texts, clashing columns, no rows."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textwarden.llm import bpe_automaton, exact_dedup, fingerprint, id_files, lang_id, license_scan, packing, queries, sharding, simhash, skew, suffix_dedup, token_ids
from textwarden.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, slot string, offset int, sequence_id string, bucket int, rec string, `group` string, fingerprint string, span int"
VOCABULARY = [f"w{i}" for i in range(60)] + ["über", "naïve", "日本語", "don't", "3.14", "🙂"]


def corpus(seed: int = 1) -> list[tuple[int | None, str | None]]:
    rnd = random.Random(seed)
    line = lambda n: " ".join(rnd.choice(VOCABULARY) for _ in range(n))
    passage, long = line(80), line(4000)
    rows = [(i, line(rnd.choice([1, 3, 30, 120]))) for i in range(40)]
    rows += [(40 + i, line(20) + " " + passage + " " + line(20)) for i in range(4)]
    rows += [(50, long), (51, long + " end"), (52, rows[5][1]), (53, rows[5][1]), (54, rows[5][1].replace(" ", "\n\t ")), (55, None), (56, ""), (57, "  \n"), (58, "a" * 700), (59, "x  y   z \n <|endoftext|> b ")]
    rows += [(60, rows[7][1]), (60, rows[7][1]), (61, "one"), (61, "two"), (None, "no key " + passage), (None, "no key " + passage), (None, None), (-5, "negative key"), (2**62, "large key")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 7, "x", 3, "y", 2, "r", "g", "f", 9) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus()).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_file(name))


def test_sharding_is_the_same_under_any_split(spark, docs):
    """The seed and the rows decide, not the partitions they come in; rows that are repeated in large numbers are dealt too."""
    rows = corpus() + [(70, "again and again")] * 300
    orders = []
    for parts, shuffled, key in ((1, "4", "text"), (3, "7", "doc_id"), (5, "2", "text")):
        spark.conf.set("spark.sql.shuffle.partitions", shuffled)
        out = sharding.shuffle_into_shards(frame(spark, rows).repartition(parts, key), 7, bucket_bytes=3000).select("shard", "slot", "doc_id", "text").collect()
        orders.append(sorted(map(tuple, out), key=lambda r: r[:2]))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert orders[0] == orders[1] == orders[2]
    other = sharding.shuffle_into_shards(frame(spark, rows), 7, seed=43, bucket_bytes=3000).select("shard", "slot", "doc_id", "text").collect()
    assert sorted(map(tuple, other), key=lambda r: r[:2]) != orders[0]
    assert len({s for s, _, k, _ in orders[0] if k == 70}) == 7


def test_sharding(spark, docs, none, tmp_path):
    out = sharding.shuffle_into_shards(docs, 7, bucket_bytes=3000)
    rows = out.collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in rows))) == sorted(map(str, corpus()))
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    sizes = [len(s) for s in slots.values()]
    assert len(slots) == 7 and max(sizes) - min(sizes) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shuffle_into_shards(none, 7).count() == 0
    few = sharding.shuffle_into_shards(frame(spark, corpus()[:3]), 7).collect()
    assert sorted(r.slot for r in few) == [0, 0, 0]
    sharding.write_shards(out, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(rows)


def test_id_files(spark, docs, none):
    path, tk = queries.tokenizer_file("word_bpe_49k.json"), tokenizer("word_bpe_49k.json")
    folder, manifest, bounds = id_files.write_ids(docs, path, 1, rows_per_shard=9)
    found = id_files.read_ids(docs.select("doc_id"), folder, manifest, bounds, with_ids=True).collect()
    assert len(bounds) > 3 and len(found) == len(corpus())
    want = collections.Counter((i, tuple(tk.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in corpus())
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in found) == want
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += len(r.ids)
    order = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda k: (k is not None, k or 0))
    strange = id_files.read_ids(spark.createDataFrame([(999_999,)], "doc_id long"), folder, manifest, bounds).first()
    assert strange.n_tokens is None
    folder, manifest, bounds = id_files.write_ids(none, path, 1)
    assert id_files.read_ids(none.select("doc_id"), folder, manifest, bounds).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(-(2**62), 2**62, 5000))
    for n in (0, 1, 2, 7, len(keys)):
        shift = id_files.build_index(keys[:n])
        assert sorted(id_files.slots_of(keys[:n], shift, n)) == list(range(n))


def brute_repeats(texts, width):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[s : s + width] for d in data for s in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for s in range(len(d) - width + 1):
            if seen[d[s : s + width]] > 1:
                gone[s : s + width] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(d), int(gone.sum()), runs, np.frombuffer(d, "u1")[~gone].tobytes()))
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 2])
def test_suffix_dedup(docs, none, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    found = suffix_dedup.remove_repeats(docs, 200).collect()
    want = brute_repeats([t for _, t in corpus()], 200)
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found) == collections.Counter((i, *w) for (i, _), w in zip(corpus(), want, strict=True))
    assert suffix_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 3])
def test_suffix_dedup_of_a_line_everywhere(spark, monkeypatch, hot):
    """A line that all texts have, in contexts that agree on some bytes only, twice in one text, with copies."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 5000)
    rnd = random.Random(7)
    letters = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    line, around = letters(150), [letters(120) for _ in range(3)]
    texts = [rnd.choice(around)[-rnd.randrange(1, 90) :] + line + rnd.choice(around)[: rnd.randrange(90)] for _ in range(24)]
    texts = [letters(80) + t + letters(80) for t in texts]
    texts += texts[:3] + [line + letters(40) + line + letters(70), letters(400) + line[:120], line * 3]
    found = suffix_dedup.remove_repeats(frame(spark, list(enumerate(texts))), 200).collect()
    want = brute_repeats(texts, 200)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found} == dict(enumerate(want))


def test_cut_texts(docs, none):
    found = suffix_dedup.cut_texts(docs)
    assert found.columns == docs.columns and suffix_dedup.cut_texts(none).count() == 0
    want = [(i, w[3].decode("utf-8", "ignore") if t is not None else None) for (i, t), w in zip(corpus(), brute_repeats([t for _, t in corpus()], 200), strict=True) if not (w[1] and not w[3])]
    assert collections.Counter((r.doc_id, r.text) for r in found.collect()) == collections.Counter(want)


def test_bpe_automaton(docs, none):
    path, tk = queries.tokenizer_file("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.json")
    out = docs.select("text", bpe_automaton.encode(F.col("text"), path).alias("ids"))
    for r in out.withColumn("back", bpe_automaton.decode(F.col("ids"), path)).collect():
        ids = tk.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.back == tk.decode(ids, skip_special_tokens=False)
    assert none.select(bpe_automaton.encode(F.col("text"), path)).count() == 0


def test_automaton_is_the_tokenizer():
    path, tk = queries.tokenizer_file("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.json")
    words = bpe_automaton.Encoder(bpe_automaton.automaton(path))
    library = token_ids.encoder(path)
    rnd = random.Random(3)
    pools = ["abcdefgh '", "aaaa b", " \n\t\r  ab", "éàüñ ßÉ", "日本語🙂 ́‍", "0123 ½٣", "é²ªºµ×÷¿¡ 1a\xa0", "\x1c\x1f\x85\xa0  a", "!?.,'s'll're ", "theing andtion"]
    texts = ["".join(rnd.choice(rnd.choice(pools)) for _ in range(rnd.randint(0, 40))) for _ in range(800)]
    want = [e.ids for e in tk.encode_batch(texts, add_special_tokens=False)]
    assert [token_ids.wide(b).tolist() for b in words(texts)] == want == [token_ids.wide(b).tolist() for b in library(texts)]
    other = tokenizer("word_bpe_49k.json")
    assert [token_ids.wide(b).tolist() for b in token_ids.encoder(queries.tokenizer_file("word_bpe_49k.json"))(texts)] == [e.ids for e in other.encode_batch(texts, add_special_tokens=False)]


def test_automaton_by_brute_force(monkeypatch):
    """The arcs of a small vocabulary are the pairs that stand side by side in some merged word, and the table alone encodes."""
    pairs = ["a b", "b a", "ab a", "a a", "c ab", "aa b", "ba ba", "ab ab"]
    letters = {c: i for i, c in enumerate("abc")}
    vocab = letters | {"".join(p.split()): 3 + i for i, p in enumerate(pairs)}
    merges = [(*(vocab[x] for x in p.split()), vocab[p.replace(" ", "")]) for p in pairs]

    def merged(word):
        tokens = list(word)
        for p in pairs:  # by rank, from the left
            a, b = p.split()
            out = []
            for t in tokens:
                out[-1:] = [out[-1] + t] if out and (out[-1], t) == (a, b) else [*out[-1:], t]
            tokens = out
        return [vocab[t] for t in tokens]

    words = ["".join(w) for n in range(1, 9) for w in itertools.product("abc", repeat=n)]
    met = {pair for w in words for pair in itertools.pairwise(merged(w))}
    a = bpe_automaton.Automaton({i: t.encode() for t, i in vocab.items()}, merges, {})
    made = [t for w, t in vocab.items() if merged(w) == [t]]  # the others never come up
    x, y = (np.array(v) for v in zip(*itertools.product(made, repeat=2), strict=True))
    assert {(int(p), int(q)) for p, q, arc in zip(x, y, a.arcs(x, y), strict=True) if arc} == met
    assert [np.frombuffer(ids, "<u2").tolist() for ids in a.words([w.encode() for w in words])] == list(map(merged, words))
    monkeypatch.setattr(bpe_automaton, "LONG_WORD", 0)
    assert [np.frombuffer(ids, "<u2").tolist() for ids in a.words([w.encode() for w in words[-3000:]])] == list(map(merged, words[-3000:]))
    a.table = np.full_like(a.table, 255)  # without the gadgets' work the encoding is another
    assert [np.frombuffer(ids, "<u2").tolist() for ids in a.words([w.encode() for w in words])] != list(map(merged, words))


def brute_selection(text):
    """Hash and position of what winnowing selects, with a hash that rolls from run to run."""
    k, w, mask = fingerprint.K, fingerprint.W, 2**64 - 1
    codes = [xxhash.xxh64_intdigest(c.encode(), seed=42) for c in text]
    if not codes:
        return []
    rolling, runs = 0, []
    for i, c in enumerate(codes):
        rolling = (rolling << 1 ^ c ^ (codes[i - k] << k if i >= k else 0)) & mask
        runs += [rolling] if i >= k - 1 else []
    hashed = [r >> 32 for r in runs or [xxhash.xxh64_intdigest(text.encode(), seed=42)]]
    picked = {}
    for at in range(max(1, len(hashed) - w + 1)):
        window = list(enumerate(hashed[at : at + w], at))
        i, h = min(window, key=lambda p: (p[1], -p[0]))
        picked[i] = h
    return [(h, i) for i, h in sorted(picked.items())]


def test_fingerprints(spark, docs, none):
    rows = [(i, t) for i, t in corpus() if i is not None and i not in (60, 61)]
    rows += [(200 + i, "日本語テキスト"[:i] + "abcdefghijk"[: i // 2]) for i in range(14)]
    found = {r.doc_id: r for r in fingerprint.compare_with_edits(frame(spark, rows).repartition(3)).collect()}
    order = sorted(rows)
    alike = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
    sets = lambda picks: {h for h, _ in picks}
    written = lambda picks: " ".join(f"{h:x}@{i}" for h, i in picks)
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r, own, changed, following = found[i], brute_selection(text), brute_selection(edited), brute_selection(after)
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (written(own), written(changed))
        assert r.near_edited == pytest.approx(alike(sets(own), sets(changed))) and r.near_next == pytest.approx(alike(sets(own), sets(following)))
    assert found[52].fingerprint == found[53].fingerprint == found[5].fingerprint and found[55].fingerprint == ""
    assert found[52].near_next == 1.0  # its next text is the same
    assert fingerprint.compare_with_edits(docs).count() == len(corpus())
    assert fingerprint.compare_with_edits(none).count() == 0


def test_fingerprints_at_any_offset(spark):
    """A passage is met again wherever it stands, without blanks too."""
    rnd = random.Random(5)
    passage = "".join(chr(rnd.randrange(0x4E00, 0x9FA5)) for _ in range(400))
    df = spark.createDataFrame([(i, passage[:i] + "x" * i + passage) for i in range(4)], "i int, text string")
    sets = [{e.split("@")[0] for e in r.fingerprint.split()} for r in fingerprint.fingerprints(df).orderBy("i").collect()]
    assert all(len(sets[0] & s) / len(sets[0] | s) > 0.9 for s in sets)
    shared = "".join(rnd.choice("abcdefgh") for _ in range(fingerprint.K + fingerprint.W - 1))  # the shortest that must be met
    df = spark.createDataFrame([("".join(rnd.choice("ijklm") for _ in range(n)) + shared + "nop" * n,) for n in range(1, 60, 7)], "text string")
    sets = [{e.split("@")[0] for e in r.fingerprint.split()} for r in fingerprint.fingerprints(df).collect()]
    assert all(a & b for a in sets for b in sets)


def test_license_scan(spark, docs, none):
    notice = license_scan.TEMPLATES["MIT"][2]
    rows = [(1, "Intro words. " + notice.replace("free of charge", "gratis") + " Rest."), (2, "released UNDER the mit license. and Licensed under CC BY-NC 4.0"), (3, "the license of the software"), (4, None), (5, "")]
    found = {r.doc_id: r.m for r in spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", license_scan.matches(F.col("text")).alias("m")).collect()}
    assert [m.license for m in found[1]] == ["MIT"] and 0.9 < found[1][0].coverage < 1 and rows[0][1][found[1][0].start :].startswith("Permission")
    assert [m.license for m in found[2]] == ["MIT", "CC-BY-NC-4.0"] and rows[1][1][found[2][0].start : found[2][0].end] == "released UNDER the mit license"
    assert found[3] == found[4] == found[5] == []
    assert docs.select(F.explode(license_scan.matches(F.col("text")))).count() == 0 == none.select(license_scan.matches(F.col("text"))).count()


def test_license_scan_of_neighbours_and_letters_that_grow():
    index = license_scan.Index(license_scan.TEMPLATES)
    texts = {
        "All rights reserved. (c) B. All rights reserved.": 2,
        "Licensed under the MIT License. Licensed under the MIT License. Licensed under the MIT License.": 3,
        "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0.": 2,
        "\u0130stanbul. Licensed under the MIT License.": 1,
    }
    for text, n in texts.items():
        found = index.scan(text)
        assert len(found) == n and all(m[2] == 1.0 for m in found)
    assert text[found[0][3] : found[0][4]] == "Licensed under the MIT License"


def test_license_scan_tells_neighbours_apart():
    index = license_scan.Index(license_scan.all_templates())
    names = {
        "This work is licensed under the GNU Lesser General Public License, version 3.": ["LGPL-3.0"],
        "This work is licensed under the GNU Affero General Public License, version 3.": ["AGPL-3.0"],
        "This work is licensed under the GNU General Public License, version 2.": ["GPL-2.0"],
        "This work is licensed under the GNU General Public License, version 4.": [],
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": ["CC-BY-SA-4.0"],
        "Licensed under CC BY 4.0. Licensed under CC BY-NC-SA 4.0.": ["CC-BY-4.0", "CC-BY-NC-SA-4.0"],
        "Licensed under the Apache License, Version 1.1.": [],
    }
    for text, want in names.items():
        assert [m[0] for m in index.scan(text)] == want
    rnd = random.Random(1)
    for name in ("Apache-2.0", "GPL-3.0", "MPL-2.0", "CC0-1.0"):
        text = license_scan.all_templates()[name][-1]
        words = text.split(" ")
        for _ in range(len(words) // 25):
            words[rnd.randrange(len(words))] = "changed"
        given = "Some words before. " + " ".join(words) + " And some after."
        whole = [m for m in index.scan(given) if m[0] == name and m[4] - m[3] > 0.9 * len(text)]
        assert len(whole) == 1 and 0.85 < whole[0][2] <= 1


def brute_common(template, words):
    """Length of the longest common subsequence."""
    row = [0] * (len(words) + 1)
    for t in template:
        above, row = row, [0]
        for j, w in enumerate(words):
            row.append(above[j] + 1 if t == w else max(row[j], above[j + 1]))
    return row[-1]


def test_alignment_by_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(60):
        template, words = rng.integers(1, 6, rng.integers(1, 25)), rng.integers(1, 6, rng.integers(1, 25))
        matched = license_scan.align(template, words, int(rng.integers(-3, 4)), 40)
        assert len(matched) == brute_common(template.tolist(), words.tolist()) and matched == sorted(set(matched))


def test_packing(spark, docs, none):
    path, tk = queries.tokenizer_file("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.json")
    cut = packing.pieces(docs, path, 0, capacity=256)
    out = packing.pack(cut, 256, max_documents=5, group_rows=50).collect()
    want = collections.Counter()
    for i, t in corpus():
        ids = np.array(tk.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for k, (at, n) in enumerate(packing.cuts(len(ids), 256)):
            want[i, k, at, n, zlib.crc32(ids[at : at + n].tobytes())] += 1
            assert n == 256 or k == 0
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    bins = collections.defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 256 and len(pieces) <= 5
    assert packing.pack(packing.pieces(none, path, 0)).count() == 0
    names = packing.pack(frame(spark, corpus()).withColumn("length", F.lit(10)), 30)
    assert names.columns.count("offset") == 1 and names.count() == len(corpus())


@pytest.mark.parametrize("measure", ["norm", "dot"])
def test_best_fit_limits(measure):
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 100, 700)
    limits = np.array([100, 4, 4000.0 + 100**2])
    bins, offsets = packing.best_fit(lengths, limits, np.array([1.0, 0.5, 0.5]), measure)
    for b in set(bins):
        own = lengths[bins == b]
        assert own.sum() <= 100 and len(own) <= 4 and (own.astype(float) ** 2).sum() <= limits[2]
    norm, _ = packing.best_fit(lengths, np.array([100, 2**31, 1e9]), np.array([1.0, 0, 0]), "norm")
    assert len(set(norm)) <= 1.05 * np.ceil(lengths.sum() / 100)


def brute_fingerprint(text, words):
    w = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), seed=42) for i in range(max(1, len(w) - words + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("per_task", [skew.PER_TASK, 2])
def test_simhash(spark, docs, none, monkeypatch, per_task):
    monkeypatch.setattr(skew, "PER_TASK", per_task)
    found = simhash.two_bit_components(docs).collect()
    prints = [brute_fingerprint(t, 3) for _, t in corpus()]
    assert collections.Counter((r.doc_id, r.fp % 2**64) for r in found) == collections.Counter((i, p) for (i, _), p in zip(corpus(), prints, strict=True))
    group = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2 and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    names = collections.defaultdict(list)
    for (i, _), g in zip(corpus(), group, strict=True):
        names[g] += [i] if i is not None else []
    want = collections.Counter((i, min(names[g], default=None)) for (i, _), g in zip(corpus(), group, strict=True))
    assert collections.Counter((r.doc_id, r.component_id) for r in found) == want
    assert simhash.two_bit_components(none).count() == 0


@pytest.mark.parametrize("near", [0, 50])
def test_simhash_links_are_whole(spark, near):
    """Also where many fingerprints share a cell: ``near`` of them differ in up to 8 bits of one segment group."""
    rng = random.Random(4)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints)[:30]:
        prints |= {p ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(3)}
    hub = rng.getrandbits(64)
    prints |= {hub ^ rng.getrandbits(9) for _ in range(near)}
    signed = lambda p: p - 2**64 if p >= 2**63 else p
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    root = {r.node: r.root for r in simhash.bit_links(df, 2).collect()}
    values = sorted(map(signed, prints))
    want = {v: v for v in values}
    for i, x in enumerate(values):
        for y in values[:i]:
            if ((x ^ y) & (2**64 - 1)).bit_count() <= 2 and want[x] != want[y]:
                low, high = sorted((want[x], want[y]))
                want = {k: low if v == high else v for k, v in want.items()}
    assert {v: root.get(v, v) for v in values} == want


def test_near_groups(spark, docs, none):
    rnd = random.Random(9)
    rows = []
    for g in range(12):
        base = [f"g{g}x{rnd.randrange(10**6)}" for _ in range(300)]
        for c in range(3):
            copy = list(base)
            for _ in range(3 * c):  # each change touches five shingles
                copy[rnd.randrange(300)] = f"n{rnd.randrange(10**6)}"
            rows.append((10 * g + c, " ".join(copy)))
    rows += [(1000 + i, " ".join(f"u{rnd.randrange(10**6)}" for _ in range(50))) for i in range(30)]
    kept = {r.doc_id for r in simhash.drop_near_copies(frame(spark, rows)).collect()}
    assert kept == {10 * g for g in range(12)} | {1000 + i for i in range(30)}
    left = simhash.drop_near_copies(docs)
    assert left.columns == docs.columns and left.filter("doc_id in (50, 51)").count() == 1
    assert simhash.drop_near_copies(none).count() == 0


def shingle_set(text, words):
    parts = text.split()
    return {tuple(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))}


def similar_pairs(rows, words=5, similarity=0.8):
    sets = [(i, shingle_set(t, words)) for i, t in rows]
    return {(i, j) for k, (i, x) in enumerate(sets) for j, y in sets[k + 1 :] if len(x & y) >= similarity * len(x | y)}


def grouped(spark, rows):
    return {r.doc_id: r.group_id for r in simhash.near_groups(frame(spark, rows)).collect()}


def components_of(pairs):
    group = {i: i for p in pairs for i in p}
    for a, b in pairs:
        low, high = sorted((group[a], group[b]))
        group = {k: low if v == high else v for k, v in group.items()}
    return group


@pytest.mark.parametrize("per_task", [skew.PER_TASK, 3])
def test_near_groups_of_a_source_with_boilerplate(spark, monkeypatch, per_task):
    """Documents that are 0.7 alike by a passage they share, each with a copy of 0.8 or more, and one with many; also if keys are dealt over tasks."""
    monkeypatch.setattr(skew, "PER_TASK", per_task)
    rnd = random.Random(4)
    word = lambda: f"v{rnd.randrange(10**6)}"
    common, rows = [word() for _ in range(170)], []
    for g in range(150):
        own = [word() for _ in range(34)]
        copy = list(own)
        copy[rnd.randrange(10, 24)] = word()
        copy[rnd.randrange(10, 24)] = word()
        rows += [(2 * g, " ".join(common + own)), (2 * g + 1, " ".join(common + copy))]
    rows += [(1000 + i, " ".join(common + own[: 12 + i % 3] + own[13 + i % 3 :]) + f" {word()}") for i in range(40)]
    pairs, found = similar_pairs(rows), grouped(spark, rows)
    assert len(pairs) >= 150
    assert found == components_of(pairs)
    assert len(set(found.values())) == 150  # the passage alone links nothing


def test_near_groups_of_chains_in_large_cells(spark):
    """Texts each of which is near to its neighbours only, all with a few rare shingles in common, so that they meet in large cells."""
    rnd = random.Random(12)
    words = [f"k{rnd.randrange(10**7)}" for _ in range(900)]
    mark = [f"m{rnd.randrange(10**7)}" for _ in range(12)]
    rows = [(i, " ".join(mark + words[5 * i : 5 * i + 100])) for i in range(36) if i % 18 != 17]
    pairs = similar_pairs(rows)
    assert len(pairs) > 30 and grouped(spark, rows) == components_of(pairs)


def test_near_groups_around_one_text(spark):
    """Copies with two changes each are near to the text in the middle but not to one another: one round finds them all."""
    rnd = random.Random(5)
    base = [f"b{rnd.randrange(10**7)}" for _ in range(104)]
    rows = [(7, " ".join(base))]
    for i in range(120):
        copy = list(base)
        for at in rnd.sample(range(4, 100, 6), 2):
            copy[at] = f"n{rnd.randrange(10**7)}"
        rows.append((100 + i, " ".join(copy)))
    assert len(similar_pairs(rows)) < 0.2 * 120 * 119 / 2
    assert grouped(spark, rows) == {i: 7 for i, _ in rows}


def test_near_groups_around_an_absent_text(spark, monkeypatch):
    """Copies of a text that isn't there, near to it but few to one another, aren't all compared pair by pair."""
    rnd, verified, compared = random.Random(15), simhash.verified, []
    base = [f"b{rnd.randrange(10**7)}" for _ in range(200)]
    rows = []
    for i in range(160):
        copy = list(base)
        for at in rnd.sample(range(5, 195, 6), 4 if i % 8 else 1):
            copy[at] = f"n{rnd.randrange(10**7)}"
        rows.append((i, " ".join(copy)))
    for i in range(160, 240):  # more changes than may be on one side
        copy = list(base)
        for at in rnd.sample(range(5, 195, 6), 6):
            copy[at] = f"n{rnd.randrange(10**7)}"
        rows.append((i, " ".join(copy)))

    def counted(pairs, *args):
        compared.append(pairs.count())
        return verified(pairs, *args)

    monkeypatch.setattr(simhash, "verified", counted)
    assert grouped(spark, rows) == components_of(similar_pairs(rows))
    assert sum(compared) <= 10 * len(rows)


def test_parities():
    """They never tell more differences than there are."""
    rnd = np.random.default_rng(1)
    for n in (0, 1, 30, 300, 3000):
        x, y = (np.unique(rnd.integers(0, 2 * n + 1, n).astype("u8") * np.uint64(0x9E3779B97F4A7C15)) for _ in "xy")
        told = np.unpackbits((simhash.parities(x) ^ simhash.parities(y)).view("u1")).sum()
        assert told <= len(np.setxor1d(x, y)) and (n < 30 or told > 0) and not (simhash.parities(x) ^ simhash.parities(x)).any()


def test_near_groups_with_equal_fingerprints(spark):
    """A line that makes more than half of the shingles decides the fingerprint, but nothing is dropped for it."""
    rnd = random.Random(3)
    rows = [(i, " ".join(["again and again this line"] * 60 + [f"z{rnd.randrange(10**6)}" for _ in range(60)])) for i in range(4)]
    assert not similar_pairs(rows) and grouped(spark, rows) == {}


def test_near_groups_at_the_similarity_itself(spark):
    """Every pair of exactly 0.8 is found: sets of one size, and one in the other."""
    rnd, rows = random.Random(6), []
    for g in range(300):
        base = [f"b{rnd.randrange(10**7)}" for _ in range(94 if g % 2 else 104)]
        other = base[:84] + [f"c{rnd.randrange(10**7)}" for _ in range(10)] if g % 2 else base[:84]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
    assert grouped(spark, rows) == {i: i - i % 2 for i, _ in rows}


def test_near_groups_with_repeated_lines(spark):
    """A line repeated in it makes no text a copy of others, and a copy no other text."""
    rnd = random.Random(8)
    own = [" ".join(f"o{rnd.randrange(10**7)}" for _ in range(60)) for _ in range(20)]
    padded = [(i, t + " pad" * 200) for i, t in enumerate(own[:10])]
    copies = [(100 + i, t) for i, t in enumerate(own[10:])] + [(200 + i, t + (" " + " ".join(t.split()[-6:])) * 40) for i, t in enumerate(own[10:])]
    copies += [(300, own[10])]
    assert grouped(spark, padded + copies) == {i: 100 + i % 100 for i, _ in copies[:-1]} | {300: 100}


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups["".join(c for c in t or "" if c not in " \t\n\r\x0b\x0c")].append((i, len(t or "")))
    out = collections.Counter()
    for text, own in groups.items():
        key, chars = min(own, key=lambda o: (-o[1], o[0] is None, o[0] or 0))
        for i, n in own:
            out[i, key, len(own), i == key and n == chars, hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


def test_exact_dedup(docs, none):
    found = exact_dedup.exact_groups(docs).collect()
    assert collections.Counter(map(tuple, found)) == brute_exact(corpus())
    assert exact_dedup.exact_groups(none).count() == 0
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and left.count() == len({r.text_digest for r in found})


def test_exact_dedup_moves_a_row_once(spark, docs):
    """Where keys are unique no text is grouped again; where rows share a digest and a key the text decides."""
    unique = frame(spark, [(i, f"text {i % 3}") for i in range(9)])
    kept = exact_dedup.drop_copies(unique)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2]
    assert "min_by" not in kept._jdf.queryExecution().toString()
    clash = frame(spark, [(1, "aa"), (1, "bb"), (2, "b b"), (3, "c"), (None, "d"), (None, "d ")])
    for digest in (exact_dedup.sha256, lambda c: F.lit("d")):
        assert sorted((r.doc_id or 0, r.text) for r in exact_dedup.drop_copies(clash, digest=digest).collect()) == [(0, "d "), (1, "aa"), (2, "b b"), (3, "c")]


def test_exact_dedup_with_colliding_digests(docs):
    weak = exact_dedup.exact_groups(docs, digest=lambda c: (F.crc32(c.cast("binary")) % 3).cast("string")).collect()
    strip = lambda rows: collections.Counter((r[0], r[1], r[2], r[3]) for r in rows)
    assert strip(weak) == strip(exact_dedup.exact_groups(docs).collect())


def test_language_id(spark, docs, none):
    rnd = random.Random(2)
    letters = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}
    make = lambda lang: " ".join("".join(rnd.choice(letters[lang]) for _ in range(rnd.randint(2, 7))) for _ in range(30))
    rows = [(i, make(lang), lang) for i in range(120) for lang in letters] + [(1, None, "aa"), (2, "123 !", "bb"), (3, "abc", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.fit(df)
    out = spark.createDataFrame([(lang, make(lang)) for lang in letters for _ in range(20)], "want string, text string")
    got = out.select("want", lang_id.predict(F.col("text"), model).alias("g")).collect()
    assert all(r.g.lang == r.want and 0.5 < r.g.score <= 1 for r in got) and 0 < model.temperature
    assert (model.weights == 0).mean() > 0.5  # the penalty leaves most weights at zero
    odd = spark.createDataFrame([(None,), ("",), ("42 - !",)], "text string").select(lang_id.predict(F.col("text"), model).alias("g")).collect()
    assert all((r.g.lang, r.g.score) == ("und", 0.0) for r in odd)
    assert docs.select(lang_id.predict(F.col("text"), lang_id.fit(none)).alias("g")).filter("g.lang != 'und'").count() == 0


def test_components(spark):
    rnd = random.Random(6)
    links = [(i, i + 1) for i in range(200)] + [(1000 + rnd.randrange(50), 1000 + rnd.randrange(50)) for _ in range(40)] + [(7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    group = {n: n for link in links for n in link}
    for a, b in links:
        low, high = sorted((group[a], group[b]))
        group = {k: low if v == high else v for k, v in group.items()}
    linked = {n for a, b in links if a != b for n in (a, b)}
    assert found == {n: group[n] for n in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_copies_with_one_key(spark):
    """Of rows with one key and equal texts the same one stays however they are dealt."""
    rows = [(1, "same text", "en", f"s{i}") for i in range(6)] + [(1, "same  text", "de", "longest"), (2, "other", "fr", "x"), (None, "no key", "en", "a"), (None, "no key", "en", "b")]
    schema = "doc_id long, text string, lang string, source string"
    kept = [sorted(map(str, exact_dedup.drop_copies(spark.createDataFrame(r, schema).repartition(n)).collect())) for r, n in ((rows, 1), (rows[::-1], 3), (rows, 5))]
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 3 and "longest" in kept[0][1] + kept[0][0] + kept[0][2]
    several = [(5, "t", "en", f"s{i}") for i in range(6)]
    one = [exact_dedup.drop_copies(spark.createDataFrame(r, schema).repartition(n)).collect() for r, n in ((several, 2), (several[::-1], 4))]
    assert one[0] == one[1] and len(one[0]) == 1

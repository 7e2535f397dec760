"""Text operators on small tables with nulls, empty and long texts, repeated rows and clashing columns, against brute force."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellframe.llm import (
    bpe_automaton, capture_index, components, decontaminate, ngram_join, secret_scan, seed_extend, shards, spot_signatures, token_codes, toxicity,
)
from cellframe.llm.queries import TOKENIZERS

WORD_BPE, BYTE_BPE = f"{TOKENIZERS}/word_bpe_49k.json", f"{TOKENIZERS}/byte_bpe_50k.json"
needs_tokenizers = pytest.mark.skipif(not os.path.isfile(BYTE_BPE), reason="tokenizer files absent")
SCHEMA = "doc_id long, text string, lang string, row string, key long, shard string, ids string, class int, sig int"
VOCABULARY = "the of and to stone river quiet Lamp, green über façade 42 naïve paper window. door hill copper under seven".split()


def prose(seed, n):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(VOCABULARY) + (str(rnd.randint(0, 999)) if rnd.random() < 0.5 else "") for _ in range(n))


def texts():
    base = prose(1, 120)
    near = base.replace(base.split()[60], "changed", 1)
    passage = prose(2, 40)
    return [
        base, near, base, None, "", " \t\n ", "one", "two words", "two words", passage + " " + prose(3, 30), prose(4, 10) + "\n" + passage, prose(5, 25) * 3,
        "password=abcdef12 token: ab1 AKIA" + "Q7" * 9 + " " + "0f" * 13, "x" * 5000, "🙂 naïve <|endoftext|>\x1c\x85 done", prose(6, 3000), base + " tail", None,
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "r", i, "s", "i", 1, 2) for i, t in enumerate(texts())]
    rows.append(rows[9])  # a repeated row
    rows.append((None, "no id at all here", None, None, None, None, None, None, None))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def local(docs):
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# token codes


@needs_tokenizers
def test_token_codes_round_trip(docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    manifest = token_codes.write(docs, WORD_BPE, chars_per_shard=3000)
    assert manifest.count() > 1
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_codes.read(manifest).collect()), key=lambda r: r[0])
    start, want = 0, []
    for doc_id, text in local(docs):
        ids = library.encode(text, add_special_tokens=False).ids + [1]
        want.append((start, doc_id, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert token_codes.read(token_codes.write(empty, WORD_BPE)).count() == 0


@pytest.mark.parametrize("widths", [(8, 8), (4,), (16, 4), (8,)])
def test_any_token_is_addressed_directly(tmp_path, widths):
    rnd = np.random.default_rng(0)
    ids = np.concatenate([rnd.integers(0, 300, 3000), rnd.integers(0, 1 << 20, 2001), [0, (1 << 32) - 1]]).astype(np.uint32)
    token_codes.put_file(str(tmp_path), "x", token_codes.shard_bytes([5, None], np.array([1000, len(ids)]), ids, widths), "a")
    shard = token_codes.Shard(str(tmp_path), "x")
    assert shard.doc_ids() == [5, None] and list(shard.ends()) == [1000, len(ids)]
    assert (shard.tokens(0, len(ids)) == ids).all()
    assert all(shard.token(i) == ids[i] for i in [0, 1, 511, 512, 513, 2999, 3000, 4096, len(ids) - 2, len(ids) - 1])
    assert (shard.tokens(777, 1300) == ids[777:2077]).all() and len(shard.tokens(3, 0)) == 0
    shard.close()


# secrets


def brute_secrets(t):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in assign.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(x[2] for x in sorted(found))


def test_secret_formats(spark, docs, empty):
    odd = [
        "", None, "token=abc", "TOKEN = 'abcdef'", "secret=token=abcdef", "password: token: abcdefgh", "apikey=zzzzzz api_key:\"yyyyyyy\"", "🙂é password=ab.cd-ef 🙂",
        "AKIAAKIA" + "0" * 16, "a" * 23 + " " + "a" * 24 + "g" + "b" * 40, " ".join("token=abc%03d" % i for i in range(700)), "passwd=" + "1" * 30, "ſecret=abcdefgh",
    ]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    for t in (table, docs):
        got = secret_scan.scan(t).select("doc_id", secret_scan.labelled(secret_scan.KINDS[:3]).alias("s")).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.s) for r in got) == sorted((d if d is not None else -1, brute_secrets(x)) for d, x in local(t))
    assert secret_scan.scan(empty).count() == 0


def test_random_tokens_are_found_and_names_are_not(spark):
    rnd = random.Random(3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rnd.choice(letters) for _ in range(40)) for _ in range(30)]
    names = ["annual_report_final_version_2019", "1111111111111111111111", "abcdefghijklmnopqrstuvwxyz0123456789", "department-of-transport-1995", "0123456789012345678901234567"]
    rows = [(i, f"see {k} there") for i, k in enumerate(keys)] + [(100 + i, f"see {n} there") for i, n in enumerate(names * 10)]
    got = {r.doc_id: r.random for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] == [(4, 44)] for i in range(30)) >= 27
    assert not any(got[100 + i] for i in range(50))


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"])
def test_random_tokens_of_one_class_are_found(spark, alphabet):
    """Keys without a digit, and of digits only, among as many long words and numbers."""
    rnd = random.Random(6)
    length, least = (20, 8) if alphabet.isdigit() else (64, 24)  # from 24 digits on it is of the kind hex
    keys = ["".join(rnd.choice(alphabet) for _ in range(length)) for _ in range(30)]
    names = ["internationalization", "Donaudampfschifffahrtsgesellschaft", "anticonstitutionnellement", "otorrinolaringologicamente", "getApplicationContextFromSession"]
    names += ["uncharacteristically", "/usr/share/documentation/", "state-of-the-art-equipment", "2019010120190102", "00000000000000001234", "a_really_long_identifier_name"]
    rows = [(i, f"see {k} there") for i, k in enumerate(keys)] + [(100 + i, f"see {n} there") for i, n in enumerate(names * 3)]
    got = {r.doc_id: r.random for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] == [(4, 4 + length)] for i in range(30)) >= least
    assert [names[i % len(names)] for i in range(len(names) * 3) if got[100 + i]] == []


def test_redaction_keeps_clean_rows(docs):
    got = secret_scan.redacted(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    by_id = {r.doc_id: r.text for r in got.collect()}
    want = dict(docs.select("doc_id", "text").collect())
    assert by_id[12] == "[SECRET] token: ab1 [SECRET] [SECRET]"
    assert all(by_id[k] == want[k] for k in want if k != 12)


# decontamination


def brute_set(t):
    w = re.findall(r"\w+", t.lower())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_containment_equals_brute_force(spark, docs, empty):
    long_item = prose(6, 3000)
    items = [prose(2, 40), "one", "", None, prose(77, 30), " ".join(prose(6, 3000).split()[500:530]), long_item, " ".join(words(prose(1, 120))[10:24])]
    items.append(" ".join(words(long_item)[100:500]) + " " + prose(8, 60))
    table = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(items)] + [(None, "one", 2, "k")], "item_id long, text string, doc_id int, keys string")
    got = {(r.doc_id, r.item_id): (r.n_shared, r.n_shingles) for r in decontaminate.leaks(docs, table).collect()}
    want = {}
    for i, item in enumerate(items):
        s = brute_set(item or "")
        for d, t in local(docs):
            shared = len(s & brute_set(t))
            if d is not None and s and shared >= 0.75 * len(s):
                want[d, i] = (shared, len(s))
    assert want and got == want
    assert decontaminate.leaks(empty, table).count() == 0 and decontaminate.leaks(docs, table.limit(0)).count() == 0
    left = decontaminate.without_leaks(docs, table)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {d for d, _ in local(docs)} - {d for d, _ in want}


# n-gram join


def brute_groups(rows):
    sets = []
    for _, t in rows:
        w = words(t.encode().lower().decode())
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    number = lambda d: -1 if d is None else d
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), 1 << 60), number(rows[i][0]))
    return sorted((number(d), len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def test_ngram_groups_equal_brute_force(spark, docs, empty):
    rnd, rows, passage = random.Random(5), [], prose(9, 60)
    for k in range(12):
        base = prose(100 + k, rnd.choice([4, 5, 6, 8, 9, 12, 20, 33, 40, 70, 130, 260]))
        for _ in range(4):
            w = base.split()
            for _ in range(rnd.randint(0, max(1, len(w) // 25))):
                w[rnd.randrange(len(w))] = rnd.choice(VOCABULARY)
            rows.append((len(rows), " ".join(w)))
        rows.append((len(rows), passage + " " + prose(500 + k, 40)))  # a shared passage is no link
        rows.append((len(rows), " ".join(base.split()[: max(1, len(base.split()) * 4 // 5)])))
    for t in (docs, spark.createDataFrame(rows, "doc_id long, text string")):
        got = sorted(tuple(-1 if x is None else x for x in r) for r in ngram_join.groups(t).collect())
        assert got == brute_groups(local(t))
    assert ngram_join.groups(empty).count() == 0
    kept = ngram_join.first_of_groups(docs)
    assert kept.columns == docs.columns and {0, 3, 4, 6}.issubset({r.doc_id for r in kept.collect()}) and 2 not in {r.doc_id for r in kept.collect()}


def test_units_always_exceed_the_difference_allowed():
    for n in [*range(1, 300), 511, 512, 4097]:
        for m in range(n, n * 4 // 3 + 1):  # m is the larger set
            least_shared = -(-75 * (n + m) // 175)
            assert n + m - 2 * least_shared < ngram_join.units_needed(m, ngram_join.band_of(n))
            assert ngram_join.band_of(n) in ngram_join.bands_of(m)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 120)] + [(7, 7)]
    got = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {k: 0 for k in range(1, 41)} | {k: 100 for k in range(101, 120)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# merge automaton


@needs_tokenizers
def test_automaton_agrees_with_the_library(docs, empty):
    from tokenizers import Tokenizer

    library, codec = Tokenizer.from_file(BYTE_BPE), bpe_automaton.Codec.of(BYTE_BPE)
    rnd, alphabet = random.Random(1), "aAbeinth' \n\t\r\x1c\x85\xa0é中🙂1²_.,!ſ​̀"
    samples = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(800)] + ["a" * 2001, " " * 500 + "x", "=-" * 300, "ab" * 700]
    for t in samples:
        ids = library.encode(t, add_special_tokens=False).ids
        assert codec.encode(t) == ",".join(map(str, ids)) and codec.decode(codec.encode(t)) == library.decode(ids, skip_special_tokens=False)
    want = []
    for d, t in local(docs):
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((-1 if d is None else d, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = bpe_automaton.round_trip(docs, BYTE_BPE).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in got) == sorted(want)
    both = bpe_automaton.decode(bpe_automaton.encode(docs, BYTE_BPE), BYTE_BPE, text="back")
    assert both.where(~F.col("back").eqNullSafe(F.coalesce("text", F.lit("")))).count() == 0
    assert bpe_automaton.round_trip(empty, BYTE_BPE).count() == 0


def test_every_state_comes_from_one_merge():
    letters = bpe_automaton.byte_letters()
    merges = [("a", "b"), ("ab", "c"), ("b", "c"), ("a", "a"), ("aa", "a")]
    vocab = {c: i for i, c in enumerate(letters)} | {a + b: 256 + k for k, (a, b) in enumerate(merges)}
    auto = bpe_automaton.MergeAutomaton(vocab, merges, letters)
    assert len(auto.without) == 1 + len(merges)
    name = {i: t for t, i in vocab.items()}
    said = lambda w: [name[i] for i in auto.encode(w)]
    assert said("abcbc") == ["abc", "bc"] and said("aaaa") == ["aa", "aa"] and said("aaa") == ["aaa"] and said("aab") == ["a", "ab"]


# toxicity


def test_toxicity_learns_and_keeps_to_its_fold(spark, docs, empty):
    rnd = random.Random(2)
    rows = [(i, prose(1000 + i, 60) + (" vile scoundrel " if i % 5 == 0 else " ") + prose(3000 + i, rnd.randint(1, 60))) for i in range(400)]
    labels = [(i, int(i % 5 == 0)) for i in range(400)] + [(5, 1), (6, None), (None, 1), (9999, 1)]
    table, own = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    scored = toxicity.score(table, toxicity.train(table, own)).withColumn("out", toxicity.held_out()).collect()
    assert {r.doc_id for r in scored if r.out} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2}
    hits = [r.toxic == int(r.doc_id % 5 == 0) for r in scored if r.out]
    assert sum(hits) >= 0.97 * len(hits)
    turned = own.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.score(table, toxicity.train(table, turned)).collect()
    assert {r.doc_id: r.toxicity for r in again} == {r.doc_id: r.toxicity for r in scored}
    model = toxicity.train(table, own)
    odd = toxicity.score(docs, model)
    assert odd.count() == docs.count() and odd.where("toxicity < 0 or toxicity > 1 or toxicity is null").count() == 0
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.score(docs, toxicity.train(empty, own.limit(0))).where("toxic = 1").count() == 0


# shards


def test_shards_are_even_and_keep_groups(spark, docs, empty):
    rows = [(i, "copy" * 5) for i in range(400)] + [(1000 + i, prose(i, 1 + i % 50)) for i in range(600)]
    got = shards.assign(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    assert len(got) == 1000
    sizes, slots = {}, {}
    text = dict(rows)
    for r in got:
        assert r["size"] == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
        sizes[r.shard] = sizes.get(r.shard, 0) + r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) < 0.05 * max(sizes.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    small = shards.assign(docs, 3)
    assert small.count() == docs.count()
    assert len({r.shard for r in small.collect() if r.doc_id in (0, 2)}) == 1
    assert shards.assign(empty, 4).count() == 0
    many = shards.assign(docs, capacity=6000).groupBy("shard").agg(F.sum("size").alias("n"), F.count("*").alias("k")).collect()
    assert len(many) >= 3 and all(r.n <= 6000 or r.k == 1 for r in many)


def test_best_fit_takes_the_tightest_bin():
    rnd = random.Random(4)
    sizes, capacity = sorted((rnd.randint(1, 60) for _ in range(500)), reverse=True), 100
    room, want = [], []
    for s in sizes:
        fits = [(r, b) for b, r in enumerate(room) if r >= s]
        b = min(fits)[1] if fits else len(room)
        if not fits:
            room.append(capacity)
        room[b] -= s
        want.append(b)
    assert shards.best_fit(sizes, capacity) == want


# captures


def test_captures_are_found_and_read_back(spark):
    big, url = "<p>" + "ü" * 200, "http://www.Example.org/a?b=1"
    rows = [(5, url, big), (3, "https://example.org/c", big), (9, None, big), (7, "no url", None), (8, "x", ""), (1, url, "short"), (2, url, "short"), (None, url, big)]
    rows += [(100 + i, f"http://h{i % 9}.net:81/p{i}", "z" * (i * 7)) for i in range(60)]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, key string").repartition(4)
    directory = capture_index.write(pages, archive_bytes=2000, block_lines=7)
    got = {r.page_id: tuple(r)[1:] for r in capture_index.read(directory).collect()}
    assert len(got) == len(rows)
    for page_id, _, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if p is not None and (h or "") == (html or "")]
        refers = min(same) if len(raw) >= 100 and same and min(same) != page_id else None
        assert got[page_id] == (len(raw), hashlib.sha256(raw).hexdigest(), "response" if refers is None else "revisit", refers)
    archive = capture_index.Archive(directory.first().folder)
    parts = capture_index.index_parts(directory)
    assert sorted(r["page_id"] or 0 for r in archive.lookup(parts, "http://example.org/a?b=1")) == [0, 1, 2, 5]
    assert [r["payload"] for r in archive.lookup(parts, "http://h3.net:81/p12")] == [b"z" * 84]
    assert archive.lookup(parts, "http://absent.net/") == []
    assert capture_index.read(capture_index.write(pages.limit(0))).count() == 0


# repeats


def brute_kept(rows):
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            first[k] = min(first.get(k, (1 << 62, 0)), (-1 if d is None else d, i))
    out = []
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - 19):
            if first[tuple(w[i : i + 20])] < (-1 if d is None else d, i):
                gone |= set(range(i, i + 20))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((-1 if d is None else d, len(w), len(gone), sha(" ".join(kept))))
    return sorted(out)


def test_repeats_equal_brute_force(spark, docs, empty):
    passage, other = prose(11, 35).split(), prose(12, 22).split()
    rows = [(i, " ".join(prose(200 + i, 15).split() + passage[i % 7 :] + prose(300 + i, 9).split() + other[: 18 + i % 5])) for i in range(30)]
    rows += [(40, " ".join(passage * 3)), (41, "a " * 90), (42, "a " * 19), (43, "b " * 20), (44, "b " * 20)]
    for t in (docs, spark.createDataFrame(rows, "doc_id long, text string")):
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in seed_extend.kept_words(t).collect())
        assert got == brute_kept(local(t))
    assert seed_extend.kept_words(empty).count() == 0


# spot signatures


def test_fingerprints_against_the_next_document(docs, empty):
    rows = local(docs)
    got = spot_signatures.against_next(docs, chars_per_task=4000).collect()
    assert len(got) == len(rows)
    want = []
    for i, (d, t) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        other = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        a, b, c = (spot_signatures.signatures(x) for x in (t, other, following))
        near = lambda x, y: len({*x} & {*y}) / len({*x} | {*y}) if len(x) + len(y) else 1.0
        want.append((-1 if d is None else d, len(t), sha(other), spot_signatures.fingerprint(a), spot_signatures.fingerprint(b), near(a, b), near(a, c)))
    assert sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in got) == sorted(want)
    assert spot_signatures.against_next(empty).count() == 0
    assert spot_signatures.against_next(docs.where("doc_id = 0")).first().near_next == 1.0
    a = spot_signatures.signatures(prose(1, 200))
    assert (spot_signatures.from_fingerprint(spot_signatures.fingerprint(a)) == a).all()
    assert spot_signatures.likeness(a, a[: len(a) // 3], least=0.5) == 0.0 and spot_signatures.likeness(a, a) == 1.0
    assert spot_signatures.with_fingerprint(docs).count() == docs.count()


def test_fingerprints_keep_32_bits():
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 1 << 32, n, dtype=np.uint64) for n in (0, 1, 2, 3, 100, 5000, 200_000)] + [np.array([0]), np.array([(1 << 32) - 1]), np.arange(300), (1 << 32) - 1 - np.arange(70)]
    for s in sets:
        s = np.unique(s.astype(np.uint32))
        back = spot_signatures.from_fingerprint(spot_signatures.fingerprint(s))
        assert back.dtype == np.uint32 and (back == s).all() and len(back) == len(s)
    assert len(spot_signatures.fingerprint(np.unique(sets[5].astype(np.uint32)))) < 0.9 * 5000 * 4
    assert spot_signatures.signatures(prose(1, 200)).max() >= 1 << 24


def test_texts_with_few_common_words_count_whole():
    rows = [f"item{i} shelf{i * 7 % 100}" for i in range(200)]
    a = spot_signatures.signatures("catalogue 1995 " + " ".join(rows[:100]))
    b = spot_signatures.signatures("catalogue 1995 " + " ".join(rows[100:]))
    c = spot_signatures.signatures("register 2001 " + " ".join(rows[:100]))
    assert spot_signatures.likeness(a, b) < 0.1 and spot_signatures.likeness(a, c) > 0.9
    assert len(a) > 150
    usual = spot_signatures.signatures("the stone of a river is quiet " * 9 + "and grey")
    assert len(usual) == 7  # the beginning, the, of, a, is, the last is, and; no further anchors


@pytest.mark.parametrize("percent", [40, 75, 100])
def test_similar_pairs_equal_brute_force(spark, docs, empty, percent):
    """Pairs far apart by doc_id, in one length partition or in two, copies, null ids and empty texts."""
    rnd, rows = random.Random(8), []
    for k in range(8):
        base = prose(700 + k, rnd.choice([12, 40, 90, 200])).split()
        for _ in range(4):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 12))):
                w[rnd.randrange(len(w))] = rnd.choice(VOCABULARY)
            rows.append((rnd.randrange(10**6), " ".join(w[: len(w) - rnd.randint(0, len(w) // 5)])))
    mixed = spark.createDataFrame([*rows, (None, rows[0][1]), (None, ""), (3, None), rows[5]], "doc_id long, text string")
    for t in (docs, mixed):
        own = sorted(set(local(t)), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        sets = [frozenset(spot_signatures.signatures(x).tolist()) for _, x in own]
        got = sorted((-1 if r.doc_id_a is None else r.doc_id_a, -1 if r.doc_id_b is None else r.doc_id_b, r.likeness) for r in spot_signatures.similar(t, percent).collect())
        number = lambda i: -1 if own[i][0] is None else own[i][0]
        firsts = {}
        for i, s in enumerate(sets):
            firsts.setdefault(s, i)
        want = [(number(firsts[s]), number(i), 1.0) for i, s in enumerate(sets) if firsts[s] != i]
        for i in firsts.values():
            for j in firsts.values():
                both = len(sets[i] & sets[j])
                if i < j and both and 100 * both >= percent * len(sets[i] | sets[j]):
                    want.append((number(i), number(j), both / len(sets[i] | sets[j])))
        ids = lambda pairs: [(*sorted(p[:2]), p[2]) for p in pairs]
        assert want and sorted(ids(got)) == sorted(ids(want))
    assert spot_signatures.similar(empty, percent).count() == 0


def test_length_partitions_hold_every_similar_pair():
    for percent in (1, 50, 75, 99, 100):
        starts = spot_signatures.partitions_of_lengths(percent)
        part = lambda n: int(np.searchsorted(starts, n, side="right")) - 1
        assert all(part(100 * n // percent) - part(n) in (0, 1) for n in [*range(1, 400), 9999])

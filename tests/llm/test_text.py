"""Substring deduplication, decontamination, licenses, language model and near-duplicates."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from foldwise.llm import base, decontaminate, licenses, lm, neardup, queries, substring

DATA = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text, kind=WORD):
    return kind.findall((text or "").translate(LOW))


def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()


def test_words_and_hashes():
    texts = ["Ab cD e", None, "", " x\ty\x0b\x1f ", "ab", "É-1_2 Ab"]
    for kind, pattern in ((base.SPACED, WORD), (base.ALNUM, ALNUM)):
        data, offsets = base.text_buffers(pa.array(texts))
        starts, ends, first = base.word_spans(data, offsets, kind)
        found = [data[s:e].tobytes().decode().translate(LOW) for s, e in zip(starts, ends, strict=True)]
        assert found == [w for t in texts for w in words(t, pattern)]
        assert np.diff(first).tolist() == [len(words(t, pattern)) for t in texts]
        hashes = base.word_hashes(data, starts, kind)
        assert len(set(zip(found, hashes.tolist(), strict=True))) == len(set(found)) == len(set(hashes.tolist()))


# ---- chunks ----


def test_chunks_resist_shifts():
    rng = random.Random(5)
    text = bytes(rng.randrange(97, 123) for _ in range(20_000))
    cuts = []
    for own in (text, text[:7000] + b"inserted" + text[7000:]):
        starts, ends = substring.cut_points(np.frombuffer(own, np.uint8), np.array([0, len(own)]))
        assert starts[0] == 0 and ends[-1] == len(own) and (starts[1:] == ends[:-1]).all()
        assert (ends - starts).max() <= substring.MOST and (ends - starts).min() > 0 and 25 < (ends - starts).mean() < 60
        cuts.append({own[b:e] for b, e in zip(starts, ends, strict=True)})
    assert len(cuts[0] - cuts[1]) <= 4


def test_chunks_do_not_depend_on_neighbouring_rows():
    data, offsets = base.text_buffers(pa.array(["zzzz " * 40, "the same text " * 30, None, "the same text " * 30]))
    starts, ends = substring.cut_points(data, offsets)
    own = [[(b - o, e - o) for b, e in zip(starts, ends, strict=True) if o <= b < p] for o, p in zip(offsets[:-1], offsets[1:], strict=True)]
    assert own[1] == own[3] and own[2] == []


def test_repeated_passages_are_found_and_cut(spark):
    rng = random.Random(6)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8))) for _ in range(n))
    passages = [fresh(55) for _ in range(20)]
    rows = [(i, f"{fresh(40)} {passages[i % 20]} {fresh(60)}") for i in range(60)] + [(i, fresh(150)) for i in range(60, 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r for r in substring.repeats(docs).collect()}
    assert all((found[i]["repeat_bytes"] > 0) == (i < 60) for i in range(120))
    assert all((found[i]["dup_bytes"] > 0) == (20 <= i < 60) for i in range(120))
    texts = {i: t.encode() for i, t in rows}
    for i in range(20, 60):
        (span,) = found[i]["spans"]
        cut, whole = texts[i][span["begin"] : span["end"]], passages[i % 20].encode()
        assert cut.strip() in whole and len(whole) - len(cut) <= 2 * 32
    assert all(found[i]["first_ids"] == [i % 20] for i in range(20, 60))
    cut = {r["doc_id"]: r["text"] for r in substring.deduplicated(docs).collect()}
    assert all(len(cut[i].encode()) == found[i]["kept_bytes"] for i in cut)
    assert all(cut[i] == t for i, t in rows if not 20 <= i < 60)


def longest_common(a, b):
    """Words of the longest word sequence that stands in both."""
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
        best = max(best, *row)
    return best


def test_repeated_passages_against_brute_force(spark):
    """Passages of 20 to 80 words, some of them copied into others: found from 51 words on, left alone under 38."""
    rng = random.Random(12)
    kinds = {"letters": lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))), "few": lambda: rng.choice(["der", "die", "das", "und", "größe", "weiß", "haus"]) + rng.choice("abcdefghij") + rng.choice("0123456789"), "beyond": lambda: "".join(rng.choice("éüñ日本語") for _ in range(rng.randint(1, 4)))}
    fresh = lambda n, kind: " ".join(kinds[kind]() for _ in range(n))
    rows = []
    for i in range(80):
        kind = list(kinds)[i % 3]
        passage = fresh(rng.choice([20, 35, 51, 51, 52, 60, 80]), kind)
        for _ in range(2 + (i % 5 == 0)):
            rows.append((f"d{len(rows):04d}", f"{fresh(rng.randint(0, 60), kind)} {passage} {fresh(rng.randint(0, 60), kind)}".strip()))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    found = {r["doc_id"]: r for r in substring.repeats(docs).collect()}
    split = {i: t.split(" ") for i, t in rows}
    near = {i: [j for j in split if j != i and len(set(split[i]) & set(split[j])) >= 10] for i in split}
    for i, own in split.items():
        most = max((longest_common(own, split[j]) for j in near[i]), default=0)
        assert not (most >= 51 and found[i]["repeat_bytes"] == 0) and not (most < 38 and found[i]["repeat_bytes"] > 0), (most, found[i])
    least = {i: min((j for j in near[i] if longest_common(split[i], split[j]) >= 51), default=None) for i in split}
    assert all((found[i]["dup_bytes"] > 0) == (least[i] < i) for i in split if least[i])


def test_stretches_without_marks_are_cut_alike_wherever_they_begin(spark):
    block = "0123456789abcdefghij" * 100
    rows = [(i, "x" * (7 * i) + " " + block[i:] + " end") for i in range(3)]
    found = substring.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["repeat_bytes"] > 1700 for r in found)


def test_chunks_of_odd_rows(odd, none):
    rows = substring.repeats(odd).collect()
    assert len(rows) == odd.count()
    assert all(r["n_chunks"] == 0 for r in rows if r["n_bytes"] == 0)
    assert sum(r["dup_bytes"] > 0 for r in rows if r["doc_id"] == 7) == 1
    assert substring.repeats(none).count() == 0
    assert substring.deduplicated(odd).columns == odd.columns and substring.deduplicated(odd).count() == odd.count()


# ---- decontamination ----


def contamination(docs, items, n=13, share=20):
    out = []
    for i, text in docs:
        own = words(text, ALNUM)
        hit, found = set(), set()
        for item, passage in items:
            theirs = words(passage, ALNUM)
            size = min(n, len(theirs))
            windows = {tuple(theirs[k : k + size]) for k in range(len(theirs) - size + 1)} if theirs else set()
            for k in range(len(own) - size + 1) if windows else ():
                if tuple(own[k : k + size]) in windows:
                    hit.update(range(k, k + size))
                    found.add(item)
        names = ",".join(sorted(found))
        out.append((i, len(own), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and share * len(hit) >= len(own)))
    return out


def test_contamination_against_brute_force(spark):
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choice(["ab", "c", "d9", "é", "F"]) for _ in range(n))
    items = [(str(i), text(rng.choice([1, 3, 5, 8, 20]))) for i in range(12)] + [("none", None), ("blank", " - "), ("0", text(4))]
    docs = [(i, text(rng.randint(0, 60)).replace(" ", rng.choice([" ", ", ", "\n-"]))) for i in range(80)] + [(99, None)]
    wanted = defaultdict(list)
    for n in (4, 13):
        wanted[n] = sorted(contamination(docs, items, n))
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    for n, limit in ((4, 1 << 20), (13, 1 << 20), (4, 30)):
        rows = decontaminate.contamination(frame, bench, n, automaton_bytes=limit).select(*names).collect()
        assert sorted(map(tuple, rows)) == wanted[n]


def test_spans_map_to_the_original(spark):
    docs = spark.createDataFrame([(1, "ÉÉ! It -- WAS,the end of it. No")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "was the END of")], "item_id long, text string")
    row = decontaminate.contamination(docs, bench).first()
    data = row["text"].encode()
    assert [data[s["begin"] : s["end"]].decode() for s in row["spans"]] == ["WAS,the end of"]


def test_contamination_of_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(None, "same row"), (1, None), (1, "five six seven")], "item_id long, text string")
    rows = decontaminate.contamination(odd, bench).collect()
    assert len(rows) == odd.count()
    assert {r["doc_id"] for r in rows if r["contaminated"]} == {1, 2, 9, 10}
    assert decontaminate.contamination(odd, bench.where("false")).where("contaminated").count() == 0
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.decontaminated(odd, bench).columns == odd.columns


# ---- licenses ----


def test_phrases_against_brute_force(spark):
    rng = random.Random(8)
    parts = ["gnu general", "general public license", "GNU General, Public License", "apache", "Apache-License", "cc by", "cc", "by", "MIT", "license", "mit license", "x"]
    docs = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for i in range(60)] + [(99, None)]
    found = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, text in docs:
        own, places, labels = words(text, ALNUM), [], set()
        for label, phrase in licenses.PHRASES:
            p = phrase.split(" ")
            at = [k for k in range(len(own)) if own[k : k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        r = found[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(own), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r["labels"].split(","))


def test_a_template_with_words_left_out_or_put_in(spark):
    text = next(t for label, t in licenses.TEMPLATES if label == "bsd-text").split(" ")
    whole, changed = " ".join(text), " ".join(text[:8] + ["really"] + text[8:14] + text[15:])
    docs = [(1, f"intro {whole} outro"), (2, f"a b c {changed}"), (3, " ".join(text[:6])), (4, " ".join(reversed(text))), (5, "All rights reserved. " * 6)]
    found = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {i: r["labels"] for i, r in found.items()} == {1: "bsd-text", 2: "bsd-text", 3: "", 4: "", 5: "rights-reserved"}
    assert [x["begin"] for x in found[5]["spans"]] == [0, 3, 6, 9, 12, 15]
    assert found[1]["score"] == 1.0 and 0.7 <= found[2]["score"] < 1 and found[3]["score"] == 0


def test_word_characters_are_one_bit_set(spark):
    # a class of ranges took ten times as long in Java
    assert "-" not in base.ALNUM_WORD
    texts = [(c, f"Ab{chr(c)}9z") for c in [*range(1, 0x300), 0x2028, 0x3000, 0xFFFD, 0x1F600]]
    rows = spark.createDataFrame(texts, "c int, text string").select("text", licenses.words_of(F.col("text")).alias("w"), licenses.n_words(F.col("text")).alias("n")).collect()
    for r in rows:
        own = words(r["text"], ALNUM)
        assert (r["w"], r["n"]) == (own, len(own))


def test_licenses_of_odd_rows(odd, none):
    rows = licenses.scan(odd).collect()
    assert len(rows) == odd.count() and all(r["labels"] == "" and r["score"] == 0 for r in rows)
    assert licenses.scan(none).count() == 0


# ---- language model ----


def test_tokens_are_hashed_in_little_memory():
    # a whole slice took 10.7 bytes for each of its own, beside tables of 67 MB
    rng = random.Random(3)
    texts = [" ".join(f"Wörd{rng.randrange(10**rng.randrange(1, 6))}" for _ in range(rng.randrange(400))) for _ in range(2500)] + ["", " ", "x"]
    data, offsets = base.text_buffers(pa.array(texts))
    assert len(data) > lm.ASK_BYTES
    lm.tokens(data, offsets)
    tracemalloc.start()
    hashes, first = lm.tokens(data, offsets)
    assert tracemalloc.get_traced_memory()[1] < 6 * len(data)
    tracemalloc.stop()
    assert len(first) == len(texts) + 1 and first[-1] == len(hashes)
    for i in (0, 1, 1200, 2499, 2500, 2501, 2502):
        assert hashes[first[i] : first[i + 1]].tolist() == [*(base.hash_word(w) for w in texts[i].split()), int(lm._END)]


def test_answers_do_not_depend_on_how_many_are_made_together(spark, monkeypatch):
    docs = base.table(spark, DATA, "documents")
    want = sorted(map(tuple, lm.score(docs, filter_bytes=0).collect()))
    monkeypatch.setattr(lm, "ANSWERED", 50)
    monkeypatch.setattr(lm, "ASK_BYTES", 1 << 15)
    found = sorted(map(tuple, lm.score(docs, filter_bytes=0).collect()))
    assert len(found) == len(want) and all(a[:5] == b[:5] and np.allclose(a[5:], b[5:], rtol=1e-12) for a, b in zip(found, want, strict=True))


def test_base_score_against_brute_force(spark):
    docs = documents(spark)
    own = {r["doc_id"]: [*words(r["text"]), None] for r in docs}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in own}
    counts = Counter(w for i, ws in own.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    frame = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    results = []
    for types in (50, 1 << 19):
        rows = lm.score(frame, frequent_types=types).collect()
        for r in rows:
            ws = own[r["doc_id"]]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(ws), sum(counts[w] > 0 for w in ws), n, held[r["doc_id"]])
            assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
            assert r["score"] < 0
        results.append({r["doc_id"]: round(r["score"], 6) for r in rows})
    assert results[0] == results[1]


def test_filter_never_loses_a_level_and_stays_in_its_bound(spark):
    counts = np.array([1, 2, 3, 4, 100, 1 << 20])
    assert lm.level(counts).tolist() == [1, 2, 2, 3, 7, 21]
    hashes = np.sort(base.splitmix(9, 3000))
    numbers = np.arange(1, 3001)
    at = lm._cut(hashes, 16)
    table = spark.createDataFrame([(0, b, lm._packed(hashes[at[b] : at[b + 1]]), lm._narrow(numbers[at[b] : at[b + 1]])) for b in range(16)], "kind int, bucket int, hashes binary, counts binary")
    bits = lm._segments(table, {0: 1, 1: 1}, 64 * 400, 16)
    found = lm.probed(bits, hashes, 0, 64 * 400, 16)
    assert (found >= lm.level(numbers)).all() and (found == lm.level(numbers)).mean() > 0.95
    assert (lm.probed(bits, base.splitmix(10, 3000), 0, 64 * 400, 16) > 0).mean() < 0.05
    assert lm._least_count([(1, 1000), (2, 10), (5, 3)], 20, lambda _: 1) == 2


def test_a_filter_over_the_broadcast_bound_holds_every_ngram(spark, odd):
    frame = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    for docs in (frame, odd.select("doc_id", "text")):
        whole, ranged = (sorted(map(tuple, lm.score(docs, filter_bytes=n).collect()), key=repr) for n in (lm.FILTER_BYTES, 16))
        assert len(whole) == len(ranged) == docs.count()
        for a, b in zip(whole, ranged, strict=True):
            assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9)


def test_score_against_brute_force(spark):
    """The model's scores from exact counts, quantised: the filter raises a level now and then by its false positives (1.2 %), and never loses one."""
    docs = documents(spark)
    own = {r["doc_id"]: [*words(r["text"]), None] for r in docs}
    train = [ws for i, ws in own.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    single, double = Counter(w for ws in train for w in ws), Counter(p for ws in train for p in zip(["START", *ws], ws, strict=False))
    n, v = sum(single.values()), len(single)
    quantised = lambda c: 0 if c == 0 else 1 if c == 1 else 1.5 * 2 ** (c.bit_length() - 1) - 0.5

    def chance(h, t):
        history = quantised(single[None if h == "START" else h])
        w = lm.BIGRAM_WEIGHT if history else 0.0
        return w * min(1.0, quantised(double[h, t]) / max(history, 1.0)) + (1 - w) * (quantised(single[t]) + 1) / (n + v + 1)

    frame = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    rows = [(r["score"], sum(math.log10(chance(h, t)) for h, t in zip(["START", *own[r["doc_id"]]], own[r["doc_id"]], strict=False)), len(own[r["doc_id"]]), r["held_out"]) for r in lm.score(frame).collect()]
    for held, bound in ((False, 0.005), (True, 0.03)):
        part = [(s, w, n) for s, w, n, h in rows if h == held]
        assert sum(abs(s - w) for s, w, _ in part) <= bound * sum(n for *_, n in part)
        assert sum(math.isclose(s, w, rel_tol=1e-9) for s, w, _ in part) >= len(part) / 10


def test_model_of_odd_rows(odd, none):
    rows = lm.score(odd).collect()
    assert len(rows) == odd.count() and all(r["n_tokens"] == 1 for r in rows if r["doc_id"] in (3, 4, 5))
    assert lm.score(none).count() == 0
    assert all(r["train_tokens"] == 0 for r in lm.score(odd.where("doc_id = 1").withColumn("doc_id", odd["doc_id"] * 0 + 24)).collect() if r["held_out"])


# ---- near-duplicates ----


def near(rows, k=5, percent=85):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    common = Counter()
    for own in where.values():
        for a in range(len(own)):
            for b in range(a):
                common[own[b], own[a]] += 1
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    least: dict = {}
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return {doc_id: (len(sets[i]), least[root(i)]) for i, (doc_id, _) in enumerate(rows)}


def test_near_duplicates_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark)]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()}
    assert found == near(rows)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == near(rows, percent=80)


def test_one_large_group_of_near_copies(spark, monkeypatch):
    """Copies with up to nine edits of one text: many pairs lie at the threshold, and the group needs several tiles."""
    # sides bounded by bytes before members
    monkeypatch.setattr(neardup, "TILE_BYTES", 200_000)
    rng = random.Random(11)
    start = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(620):
        own = list(start)
        for _ in range(rng.randint(0, 9)):
            own[rng.randrange(120)] = f"n{rng.randrange(30)}"
        rows.append((1000 - i, " ".join(own)))
    rows += [(2000 + i, " ".join(start)) for i in range(300)]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), percent=85).collect()}
    assert found == near(rows)


def test_pivots_and_tiles_of_one_group():
    """Links over pivots, and then from what is loose to the rest, connect what brute force connects."""
    rng, least = np.random.default_rng(3), neardup.least_matches(0.85, 1e-5)
    start = rng.integers(0, 1 << 62, 200, dtype=np.uint64)
    sets = []
    for _ in range(150):
        own, at = start.copy(), rng.permutation(200)[: rng.integers(0, 30)]
        own[at] = rng.integers(0, 1 << 62, len(at), dtype=np.uint64)
        sets.append(np.unique(own))
    sigs = [neardup.signature(s).astype(np.uint8).tobytes() for s in sets]
    group = neardup._Sets(pa.table({"node": pa.array(range(150), pa.int64()), "sig": sigs, "set": [s.tobytes() for s in sets]}), least, 85)

    def roots(links):
        root = list(range(150))
        for a, b in links:
            root = [root[a] if r == root[b] else r for r in root]
        return {frozenset(i for i in range(150) if root[i] == r) for r in set(root)}

    common = {(i, j): len(np.intersect1d(sets[i], sets[j])) for i in range(150) for j in range(i)}
    wanted = roots([p for p, c in common.items() if 100 * c >= 85 * (len(sets[p[0]]) + len(sets[p[1]]) - c)])
    pivots = np.arange(150) % 20 == 0
    links, loose = neardup.pivot_links(group, pivots)
    assert 0 < len(loose) < 150
    settled = ~np.isin(np.arange(150), loose)
    assert roots(links + neardup.tile_links(group, settled, None)) == wanted
    assert roots(neardup.tile_links(group, np.zeros(150, bool), None)) == wanted


def test_chain_of_near_copies(spark):
    own = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(40):
        own[5 * i] = f"new{i}"
        rows.append((500 - i, " ".join(own)))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()}
    assert found == near(rows) and len({c for _, c in found.values()}) == 1


def test_pruning_bound():
    least = neardup.least_matches(0.85, 1e-5)
    assert sorted(least) == [32, 64, 96, 128] and 80 < least[128] < 95
    assert all(a < b for a, b in zip(least.values(), list(least.values())[1:], strict=False))


def test_near_duplicates_of_odd_rows(odd, none):
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by_id = defaultdict(set)
    for r in rows:
        by_id[r["doc_id"]].add(r["component_id"])
    assert by_id[10] == {9} and by_id[9] == {9} and 1 in by_id[2] and by_id[3] == {3} and by_id[4] == {4} and by_id[5] == {5} and by_id[None] == {None}
    kept = neardup.without_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 2, 3, 4, 5, 6, 7, 8, 9]
    assert neardup.near_duplicates(none).count() == 0 and neardup.without_near_duplicates(none).count() == 0


def test_registered_queries_run(spark):
    for name, f in queries.queries().items():
        assert f(spark, DATA).limit(1).count() == 1, name

"""The corpus operators against brute force, on the smallest tables and on awkward rows."""

from __future__ import annotations

import collections
import hashlib
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import connect, difference
from murmura.llm import (
    chat,
    components,
    decontamination,
    line_dedup,
    near_dedup,
    packing,
    quality,
    registered,
    secret_scan,
    storage,
    token_files,
    tokens,
    toxicity,
    warc,
)

FOLDER = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i}" for i in range(4000))
COPY = " ".join(f"c{i}" for i in range(60))
TEXTS = [
    None,
    "",
    " \t\n ",
    "a",
    LONG,
    COPY,
    COPY.upper(),
    COPY + " tail",
    "Same line here\n  sAME LINE HERE \nother\n\n",
    "same line here",
    "Éa long line é\nÉA LONG LINE É",
    'pAsSwOrd = "abcdefgh12" AKIAABCDEFGHIJKL ' + "0af" * 12,
    "a b c a b c a b c",
]


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(k, text, None, k) for k, text in enumerate(TEXTS)]
    rows += [(5, COPY, "x", 1), (None, COPY, "x", 1), (None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, failed string, score int").repartition(3)


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.where("false")


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def run(spark, name):
    return registered.queries()[name](spark, FOLDER).collect()


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_agrees_with_sql(spark, name):
    query, sql = registered.queries()[name], registered.oracle_sql()[name]
    assert difference(query(spark, FOLDER), connect(FOLDER), sql) is None


def measures(text):
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    places = collections.defaultdict(list)
    for i in range(len(w) - 2):
        places[tuple(w[i : i + 3])].append(i)
    repeated = {i + k for v in places.values() if len(v) > 1 for i in v for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def test_quality_rules(spark, documents, awkward, empty):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in run(spark, "op7_quality_rules")}
    assert got == {k: measures(t) for k, t in documents.items()}
    led = quality.decided(quality.ledger(awkward))
    for row in led.collect():
        want = measures(row.text or "")
        assert (row.n_words, row.n_repeat_words) == (want[0], want[4])
        assert row.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (row.base_failed and row.kept)
    by_rule = {r["rule"]: r for r in quality.ablation(led).collect()}
    assert by_rule["few_words"].n_failed == led.where("n_words < 50").count()
    assert led.where("kept").count() == quality.decided(quality.ledger(awkward)).where("kept").count()
    assert quality.ledger(empty).count() == 0


def lines_kept(docs):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    order = lambda k: (k is None, k or 0)
    holders = collections.defaultdict(set)
    for k, text in docs:
        for line in (text or "").split("\n"):
            holders[key(line)].add(order(k))
    drop = lambda k, line: len(key(line)) >= 10 and min(holders[key(line)]) != order(k)
    return collections.Counter((k, "\n".join(x for x in (t or "").split("\n") if not drop(k, x))) for k, t in docs)


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (4, 3), (7, 2)])
def test_line_dedup(spark, documents, awkward, empty, batches, fanout):
    got = line_dedup.dedup_lines(awkward, batches, fanout).collect()
    want = lines_kept([(r.doc_id, r.text) for r in awkward.collect()])
    assert collections.Counter((r.doc_id, r.text or "") for r in got) == want
    if batches == 4:
        assert {(r.doc_id, r.kept_sha256) for r in run(spark, "op9_line_dedup")} == {
            (k, sha(t)) for k, t in lines_kept(list(documents.items()))
        }
    assert line_dedup.dedup_lines(empty, batches, fanout).count() == 0


def test_chat_round_trip(spark):
    rows = [
        (1, 2, "user", "x <|im_sep|> \\n \\| \\\\| <\\|"), (1, 1, "a\nb\\n<|", None), (1, 3, "user", ""),
        (1, 4, "assistant", "é🙂\n"), (1, 4, "assistant", "é🙂\n"), (2, None, None, "t"), (None, 1, "assistant", "<|im_end|>\n"),
    ]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(turns)).collect()}
    for conv in (1, 2, None):
        own = sorted(((t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert [(t.role, t.text) for t in got[conv].turns] == [x[1:] for x in own]
        assert got[conv].learned == [x for _, r, x in own if r == "assistant"]
    assert got[1].formatted.count("<|im_start|>user") == 1
    assert chat.format_chats(turns.where("false")).count() == 0
    assert -1 in {r.conv_id for r in run(spark, "op3_chat_formatting")}


def test_secrets(spark, documents, awkward, empty):
    rule = secret_scan.RULES[0].compiled()

    def base(text):
        found = [(m.start(), 0, m.end()) for m in rule.finditer(text) if len(m[2]) >= 8]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))

    assert {r.doc_id: r.base_sha256 for r in run(spark, "op1_secret_scan")} == {k: sha(base(t)) for k, t in documents.items()}
    spans = {r.doc_id: r.spans for r in secret_scan.scan(awkward).collect()}
    assert [x.kind for x in spans[11]] == ["assign", "access", "hex"]
    assert secret_scan.scan(empty).count() == 0


def test_trigram_queries():
    assert secret_scan.trigram_query("[0-9a-f]+") == secret_scan.ALL
    assert secret_scan.trigrams(secret_scan.trigram_query("AKIA[A-Z]+")) == {b"aki", b"kia"}
    assert secret_scan.trigram_query("abc|x") == secret_scan.ALL
    assert secret_scan.trigrams(secret_scan.trigram_query("(abc|xyz)?def")) >= {b"def"}


def test_rules_with_capitals_beyond_ascii(spark):
    rules = (secret_scan.Rule("word", "Äpfel[0-9]+"), secret_scan.Rule("class", "[ÄÖ]bcd"))
    rows = [(1, "xx Äpfel12 yy"), (2, "Öbcd äpfel1"), (3, "äpfel1 öbcd")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: [tuple(x) for x in r.spans] for r in secret_scan.scan(docs, rules).collect()}
    assert got == {1: [("word", 3, 10)], 2: [("class", 0, 4)], 3: []}


def test_tokens_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    path = registered.tokenizer()
    plain, own = Tokenizer.from_file(path), tokens.encoder(path)
    pieces = ["a", "É", "don't", " ", "  ", "\n", "\n\n", ".", ", ", "\t", "x1", "<|endoftext|>", "\0", "漢字", "🙂", "\x1c", "\x85", " '"]
    draw = np.random.Generator(np.random.PCG64(1))
    texts = ["".join(draw.choice(pieces, draw.integers(0, 9))) for _ in range(3000)]
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_common_words_stay_when_more_are_met_than_remembered(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 100)
    plain, own, learned = tokens.encoder(registered.tokenizer()), tokens.Encoder(registered.tokenizer()), []
    learn = own._learn
    monkeypatch.setattr(own, "_learn", lambda pieces: (learned.extend(pieces), learn(pieces))[1])
    for k in range(30):
        text = "a common word, " + " ".join(f"w{k}x{i}." for i in range(20)) + " \nend; "
        assert own.encode([text, ""]) == plain.encode([text, ""])
    assert learned.count(" common") == learned.count(" word,") == 1


def test_texts_come_as_arrow_columns_too(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "REMEMBERED", 40)
    plain, own = Tokenizer.from_file(registered.tokenizer()), tokens.Encoder(registered.tokenizer())
    pieces = ["word", " é,", " an", " x1.", " ", "\n", ".", "Ж;", " 漢字!", "\t", "\0", "\u2028", " <|endoftext|>", "?"]
    draw = np.random.Generator(np.random.PCG64(2))
    texts = ["".join(draw.choice(pieces, draw.integers(0, 9))) + f" w{k}" * (k % 2) for k in range(2000)]
    texts = [None if k % 7 == 3 else "" if k % 11 == 5 else x for k, x in enumerate(texts)]
    want = [np.array(plain.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    for kind in (pa.string(), pa.large_string()):
        column, got = pa.array(texts, kind), []
        for first in range(0, len(texts), 30):
            got += own.encode(column.slice(first, 30))
        assert got == want
        for few in ([None, "", None], ["", None], []):
            assert own.encode(pa.array(few, kind)) == [b""] * len(few)
        assert own.encode(pa.array(["a b", None, "", "\n"], kind).slice(1, 2)) == [b"", b""]
    assert len(own._pieces) < 40 + 30 * 20


def test_remembered_words_are_no_python_objects():
    import tracemalloc

    own = tokens.Encoder(registered.tokenizer())
    text = " ".join(f"w{i}" for i in range(40_000))
    tracemalloc.start()
    try:
        own.encode([text])
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 1_500_000


def test_words_of_many_texts_stay_few_in_memory():
    own = tokens.Encoder(registered.tokenizer())
    for k in range(14):
        own.encode([" ".join(f"w{i}" for i in range(50_000 * k, 50_000 * (k + 1)))])
    held = sum(len(x) for x in vars(own).values() if isinstance(x, dict))
    assert held < 600_000


def encoded(docs, end):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(registered.tokenizer())
    return [(k, plain.encode(t or "", add_special_tokens=False).ids + [end]) for k, t in docs]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_token_files(spark, documents, awkward, empty):
    want, start = {}, 0
    for k, ids in encoded(sorted(documents.items()), 2):
        want[k] = (start, len(ids), crc(ids))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in run(spark, "op10_token_files")} == want
    for docs, n in ((awkward, len(TEXTS) + 3), (empty, 0)):
        folder = storage.shared_folder(spark)
        token_files.write_tokens(docs, folder, registered.tokenizer(), shards=3)
        rows = sorted(token_files.read_tokens(spark, folder).collect(), key=lambda r: r.start)
        assert len(rows) == n
        assert [r.start for r in rows] == [sum(len(x.ids) for x in rows[:i]) for i in range(n)]


def sound(rows, capacity):
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        own.sort()
        assert own[0][0] == 0 and sum(n for _, n in own) <= capacity
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
    return len(sequences)


def test_packing(spark, documents, awkward, empty):
    rows = run(spark, "op2_best_fit_packing")
    want = set()
    for k, ids in encoded(documents.items(), 0):
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048), len(ids)]
        want |= {(k, i, a, b - a, crc(ids[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    bound = -(-sum(r.length for r in rows) // 2048)
    assert bound <= sound(rows, 2048) <= 1.02 * bound + 1
    small = packing.pack(awkward, registered.tokenizer(), capacity=64).collect()
    sound(small, 64)
    assert packing.pack(empty, registered.tokenizer()).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_exactly_the_histogram(seed):
    draw = np.random.Generator(np.random.PCG64(seed))
    histogram = {int(x): int(n) for x, n in zip(draw.integers(1, 257, 40), draw.integers(1, 3000, 40))}
    patterns = packing.plan(histogram, 256, 60)
    held = collections.Counter()
    for pattern, times in patterns.items():
        assert sum(a * n for a, n in pattern) <= 256
        for length, n in pattern:
            held[length] += n * times
    assert held == collections.Counter(histogram)


def spread(seed, lengths, capacity):
    """A histogram of many lengths, most of them rare, and of full pieces."""
    draw = np.random.Generator(np.random.PCG64(seed))
    counts = collections.Counter(np.minimum(draw.lognormal(5.5, 1.3, 6 * lengths), capacity).astype(int).tolist())
    return {length: n for length, n in counts.items() if length}


@pytest.mark.parametrize(("seed", "lengths", "capacity"), [(0, 30, 2048), (1, 300, 2048), (2, 200, 256)])
def test_program_covers_every_length_and_places_most_tokens(seed, lengths, capacity):
    histogram = spread(seed, lengths, capacity)
    tokens_ = sum(length * n for length, n in histogram.items())
    covered = collections.Counter()
    amounts = packing.fractional(histogram, capacity)
    for pattern, amount in amounts.items():
        for length, n in pattern:
            covered[length] += amount * n
    assert all(0.98 * n <= covered[length] + 1e-6 <= n + 2e-6 for length, n in histogram.items())
    assert sum(amounts.values()) <= 1.03 * tokens_ / capacity + 1
    chosen, left = packing.program(histogram, capacity)
    placed = sum(length * n * times for pattern, times in chosen.items() for length, n in pattern)
    assert placed >= 0.97 * tokens_
    assert placed + sum(length * n for length, n in left.items()) == tokens_
    # What the program has composed stays; best fit only adds to it.
    kept = collections.Counter()
    for pattern, times in packing.plan(histogram, capacity).items():
        kept[pattern] += times
    assert sum(min(n, kept[p]) for p, n in chosen.items()) >= 0.8 * chosen.total()
    assert kept.total() <= 1.02 * tokens_ / capacity + 1


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (7, 4), (20, 21), (5, 5)] + [(k, k + 1) for k in range(100, 160)]
    got = dict(components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert {got[k] for k in (2, 3, 4, 7, 8, 9)} == {1} and got[21] == 20
    assert all(got[k] == 100 for k in range(101, 161))


def test_near_duplicates(spark, documents, awkward, empty):
    sets = {}
    for k, text in documents.items():
        w = words(text.translate(LOW))
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    group = {k: k for k in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {k: low if g == high else g for k, g in group.items()}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in run(spark, "op8_near_dedup")}
    assert got == {k: (len(sets[k]), group[k], group[k] == k) for k in sets}
    rows = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_dedup.near_duplicates(awkward).collect()}
    assert rows[5, 56] == (5, True) and rows[6, 56] == (5, False) and rows[7, 57] == (5, False)
    assert rows[None, 56] == (5, False) and rows[None, 0] == (None, True) and rows[1, 0] == (1, True)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_blocks_find_what_pivots_miss(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    base = [f"b{i}" for i in range(100)]
    change = lambda at: " ".join("x" if i in at else w for i, w in enumerate(base))
    # Each is like the next one, the ends are not like each other.
    texts = [change(range(k, k + 1 + 2 * (k > 0))) for k in (0, 2)] + [change(range(50, 50 + n)) for n in (4, 8, 12, 16)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    w = [t.split() for t in texts]
    sets = [{tuple(x[i : i + 5]) for i in range(96)} for x in w]
    group = list(range(len(texts)))
    for _ in texts:
        for a in group:
            for b in range(len(texts)):
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
    assert [r.component_id for r in near_dedup.near_duplicates(docs).orderBy("doc_id").collect()] == group


def test_contamination(spark, awkward, empty):
    item = " ".join(f"item{i}" for i in range(30))
    near = item.replace("item15", "other")
    rows = [(1, f"a b c {item} d e"), (2, near.upper()), (3, "item1 item2 item3 item4 item5"), (4, item[: len(item) // 2]), (5, None), (6, " ".join(item.split()[1:]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    items = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id bigint, text string")
    found = {r.doc_id: r for r in decontamination.contaminated(docs, items).collect()}
    # One word changed of thirty leaves 21 of 31 shingles: below the threshold.
    assert set(found) == {1, 6} and (found[1].first_word, found[1].n_words, found[1].similarity) == (3, 30, 1.0)
    assert {r.doc_id for r in decontamination.clean(docs, items).collect()} == {2, 3, 4, 5}
    assert decontamination.clean(awkward, items).columns == awkward.columns
    assert decontamination.clean(awkward, items).count() == awkward.count()
    assert decontamination.contaminated(empty, items).count() == 0
    assert decontamination.contaminated(docs, items.where("false")).count() == 0
    assert all(r.similarity >= 0.75 for r in run(spark, "op4_decontamination"))


def passages(docs, items):
    """``{(doc_id, item_id): (similarity, first_word, n_words)}`` by all windows of all documents that share a shingle."""
    def shingled(w):
        return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []

    split = lambda text: words((text or "").translate(LOW))
    benchmark = {k: (len(split(t)), collections.Counter(shingled(split(t)))) for k, t in items}
    holders = collections.defaultdict(set)
    for k, (_, counts) in benchmark.items():
        for x in counts:
            holders[x].add(k)
    found = {}
    for doc, text in docs:
        w = split(text)
        whole = shingled(w)
        for item in sorted(set().union(*(holders.get(x, ()) for x in whole))):
            size, wanted = benchmark[item]
            n = min(size, len(w))
            width, have, shared = max(1, n - 4), collections.Counter(), 0
            for i, x in enumerate(whole):
                shared += have[x] < wanted.get(x, 0)
                have[x] += 1
                if i >= width:
                    gone = whole[i - width]
                    have[gone] -= 1
                    shared -= have[gone] < wanted.get(gone, 0)
                if i >= width - 1:
                    alike = shared / (width + wanted.total() - shared)
                    if 100 * alike >= 75 and alike > found.get((doc, item), (0,))[0]:
                        found[doc, item] = (alike, i - width + 1, n)
    return found


def test_contamination_is_that_of_all_windows(spark, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    want = passages(documents.items(), items)
    got = {(r.doc_id, r.item_id): (r.similarity, r.first_word, r.n_words) for r in run(spark, "op4_decontamination")}
    assert want and got == {k: (round(a, 9), b, c) for k, (a, b, c) in want.items()}
    # Passages near the threshold: a run of words changed at different places.
    w = [f"i{k}" for k in range(60)]
    rows = [(at, " ".join(["before"] * 7 + w[:at] + ["x"] * n + w[at + n :] + ["after"] * 3)) for at, n in ((8, 1), (20, 2), (30, 3), (40, 4))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    one = spark.createDataFrame([(7, " ".join(w))], "item_id bigint, text string")
    want = passages(rows, [(7, " ".join(w))])
    assert any(0.75 <= x[0] <= 0.8 for x in want.values())
    got = {(r.doc_id, r.item_id): (r.similarity, r.first_word, r.n_words) for r in decontamination.contaminated(docs, one).collect()}
    assert got == want


def test_grammar():
    model = toxicity.Model(frozenset({"fool"}), frozenset({"scoun"}))
    events = lambda text: [dict(c) for _, _, c in model.clauses(text)]
    assert events("You are a fool. fool") == [{"insult_at": 1}, {"insult": 1}]
    assert events("not a fool; he said fool") == [{"negated": 1}, {"reported": 1}]
    assert events("not one of the many here is a fool") == [{"insult": 1}]
    assert events("scoundrels! I kill you") == [{"insult": 1}, {"threat": 1}]
    assert events("foolish, unfool") == [] and events("") == []


def test_toxicity(spark, awkward, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    held = toxicity.scored(docs, model).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id")))
    right = held.agg(
        F.sum(F.when((F.col("score") >= 0.7) & (F.col("toxic") == 1), 1)).alias("hit"),
        F.count_if(F.col("score") >= 0.7).alias("said"),
        F.sum("toxic").alias("toxic"),
    ).first()
    assert right.hit >= 0.9 * right.toxic and right.hit >= 0.99 * right.said
    assert all(0 <= r.score <= 1 for r in toxicity.scored(awkward, model).collect())
    assert toxicity.scored(empty, model).count() == 0
    assert toxicity.fit(docs, labels.where("false")).words == frozenset()


def test_archives(spark):
    long_ = "a" * 1200
    rows = [(1, "http://a b\r\nX: y", long_), (2, None, long_), (3, "u", "WARC/1.1\r\nWARC-Type: x\r\n\r\nWARC/1.1\r\n"), (None, "u", None), (2, None, long_), (5, "u", "é\r\n\r\nWARC/1.1\r\n\r\n")]
    for kept in (rows, []):
        folder = storage.shared_folder(spark)
        warc.write_archives(spark.createDataFrame(kept, "page_id bigint, url string, html string").repartition(2), folder)
        got = warc.read_captures(spark, folder).collect()
        want = collections.Counter((k, 2 if k == 1 else None, None if k == 1 else (h or "")) for k, _, h in kept)
        assert collections.Counter(
            (r.page_id, r.refers_to_page, r.response.payload and r.response.payload.decode() if r.response.payload is None else bytes(r.response.payload).decode()) for r in got
        ) == want
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    assert {r.page_id: r.payload_digest for r in run(spark, "op6_warc")} == {k: hashlib.sha1((h or "").encode()).hexdigest() for k, h in pages.items()}


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, FOLDER).collect()
    sound(rows, 2048)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == docs.columns
    good = {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, FOLDER).collect()}
    assert {r.doc_id for r in rows} <= good

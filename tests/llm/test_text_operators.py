"""Text operators against brute force, on odd cases and on the given tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from anualia.llm import (
    addressable, compression_quality, decontaminate, mixing, near_duplicates, oracle, pii, queries, rules, token_counts,
    token_output,
)
from anualia.llm.covering import RADIUS, Code
from tests.compare import connect, difference
from tests.llm.conftest import odd_rows

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def given(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    return df, [(r.doc_id, r.text) for r in df.collect()]


@pytest.mark.parametrize("name", sorted(oracle.all_sql()))
def test_sql(spark, name):
    problem = difference(queries.all_queries()[name](spark, SF), connect(SF), oracle.all_sql()[name])
    assert problem is None, problem


# ---- mixing ----------------------------------------------------------------------


def brute_targets(sizes):
    total = sum(sizes.values())
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s else b""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    closed = {}
    while True:
        rest = total - sum(closed.values())
        share = sum(w for s, w in weight.items() if s not in closed)
        new = {s: 3 * sizes[s] for s in order if s not in closed and share and weight[s] * rest / share >= 3 * sizes[s]}
        if not new:
            return {s: closed.get(s, weight[s] * rest / share if share else 0.0) for s in order}
        closed |= new


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in odd_rows())
    sizes = defaultdict(int)
    for r in odd_rows():
        sizes[r[3]] += len(words(r[1]))
    want = brute_targets(sizes)
    taken = defaultdict(int)
    for r in rows:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
    largest = {s: max(len(words(x[1])) for x in odd_rows() if x[3] == s) for s in sizes}
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))


def test_take_repeats_documents(docs):
    taken = {(r.doc_id, r.source, r.size): r.repeats for r in mixing.mix(docs).collect()}
    got = mixing.take(docs)
    assert got.columns == docs.columns
    counts = Counter((r.doc_id, r.source, len(words(r.text))) for r in got.collect())
    rows = Counter((r[0], r[3], len(words(r[1]))) for r in odd_rows())
    assert counts == Counter({k: n * rows[k] for k, n in taken.items() if n})


# ---- decontamination ---------------------------------------------------------------


def test_decontamination(spark, docs):
    all_words = [words(r[1]) for r in odd_rows()]
    items = [(1, " ".join(all_words[7][100:130])), (2, " ".join(all_words[0][5:20]).upper()), (3, "tab gap LINE"), (4, None),
             (5, ""), (6, "not there at all in any text of these"), (2, " ".join(all_words[0][5:20])), (None, "one, two!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.matches(docs, bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(8, 1), (1, 2), (2, 2), (3, 2), (9, 3), (7, None), (16, None)}
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {4, 5, 6, None, 11, 12, 13, 14, 15}
    assert kept.count() == 12


def test_containment_threshold(spark):
    """Found from four fifths of the shingles on, whatever the item's size."""
    rows, items = [], []
    for n in (5, 9, 10, 14, 30, 77):
        item = [f"w{n}x{i}" for i in range(n)]
        items.append((n, " ".join(item)))
        shingles = n - 4
        for missing in range(shingles + 1):
            rows.append((n * 1000 + missing, "before it " + " ".join(item[: n - missing]) + " after it all"))
    got = decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = {(n * 1000 + m, n) for n in (5, 9, 10, 14, 30, 77) for m in range(n - 3) if (n - 4 - m) >= 0.8 * (n - 4) - 1e-9}
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_decontamination_of_empty_tables(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.matches(docs, none).count() == 0
    assert decontaminate.decontaminate(docs, none).count() == docs.count()
    assert decontaminate.matches(no_docs, spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0


# ---- rules -------------------------------------------------------------------------


def brute_measures(text):
    text = text or ""
    w = words(text)
    runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen = Counter(runs)
    covered = {i + k for i, r in enumerate(runs) if seen[r] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_rules(docs):
    got = [tuple(r) for r in rules.measured(docs).collect()]
    want = Counter((r[0], *brute_measures(r[1])) for r in odd_rows())
    assert Counter(g[:6] for g in got) == want
    for _, n, _, _, _, repeated, failed, kept in got:
        assert failed == (n < 20 or 100 * repeated > 30 * n) and not (failed and kept)


def test_cascade_keeps_what_no_rule_rejects(docs):
    chain = rules.base_rules() + rules.default_rules()
    kept = rules.cascade(docs, chain)
    assert kept.columns == docs.columns
    want = Counter(r.doc_id for r in rules.measured(docs).where("kept").collect())
    assert Counter(r.doc_id for r in kept.collect()) == want
    assert Counter(r.doc_id for r in rules.cascade(docs, chain[::-1]).collect()) == want


def test_rules_of_an_empty_table(no_docs):
    assert rules.measured(no_docs).count() == 0 and rules.cascade(no_docs).count() == 0


# ---- personal data -------------------------------------------------------------------


def brute_base(text):
    text = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        odd = sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])
        if 16 <= len(d) <= 19 and odd % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


HARD = [
    "a@b@c.d.e@f.g x@y.z@w.v", "@@a.b@c.d", "a.@-.-", "1.2.3.4.5.6.7.8.9", "1.2.3", "0255.1.1.1 256.1.1.1", "4111-1111 1111-1111-",
    "4111  1111 1111 1111", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "++1(23)4567-89.0-", "9" * 5000, "1." * 3000, "+" * 100 + "1 23456789",
    "x" * 3000 + "@a.b", "4111111111111111 4111111111111111", "é@é.é a@b.cé",
]


def test_base_spans(spark, docs, given):
    texts = [t for _, t in given[1]] + HARD + [r[1] for r in odd_rows()]
    for text in texts:
        base = [(pii.KINDS[s.kind], s.start, s.end) for s, is_base in pii.find(text) if is_base]
        assert base == brute_base(text)
    rows = {r.doc_id: r for r in pii.digests(pii.find_spans(docs)).collect()}
    want = brute_base(dict((r[0], r[1]) for r in odd_rows())[15])
    assert rows[15].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
    assert (rows[15].n_email, rows[15].n_ip, rows[15].n_card, rows[15].n_phone) == (1, 1, 1, 1)
    assert rows[4].spans == "" and rows[4].base_sha256 == hashlib.sha256(b"").hexdigest()
    text = dict((r[0], r[1]) for r in odd_rows())[16]
    found = [tuple(s.split(":")) for s in rows[16].spans.split(",")]
    assert [(k, text[int(a) : int(b)]) for k, a, b in found] == [
        ("email", "jo [at] ex [dot] com"), ("phone", "plus four nine one two three four five six seven"),
    ]


@pytest.mark.parametrize("disguised, kind", [
    ("jоhn@ехаmple.com", "email"), ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email"), ("john(at)example.com", "email"),
    ("john.doe [at] mail [dot] example [dot] com", "email"), ("john at example dot com", "email"), ("john&#64;example.com", "email"),
    ("10[.]0[.]0[.]1", "ip"), ("10 dot 0 dot 0 dot 1", "ip"), ("+one five five five one two three four five six", "phone"),
    ("４１１１ １１１１ １１１１ １１１１", "card"), ("four one one one 1111 1111 one one one one", "card"),
    ("+un deux trois quatre cinq six sept huit neuf", "phone"), ("𝟏𝟎.𝟎.𝟎.𝟏", "ip"),
])
def test_disguises(disguised, kind):
    text = f"Sagt: {disguised} später, 日本語"
    assert [(pii.KINDS[s.kind], text[s.start : s.end]) for s, _ in pii.find(text)] == [(kind, disguised)]


def test_clean_texts_get_no_spans():
    for text in ("He sat at home on a dot", "un deux trois", "at one two three", "Привет, как дела?", "a [at] b", "one dot two"):
        assert pii.find(text) == []


# ---- token counts ----------------------------------------------------------------------


def greedy(word, pieces, longest):
    """Longest match first, by trying every length."""
    count, at = 0, 0
    while at < len(word):
        for size in range(min(longest, len(word) - at), 0, -1):
            if word[at : at + size] in pieces:
                break
        else:
            return 1
        count, at = count + 1, at + size
    return count


def test_token_counts(docs, given):
    pieces = token_counts.byte_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    known, longest = set(pieces), max(map(len, pieces))
    assert len(pieces) == 50256
    for df, rows in ((docs, [r[:2] for r in odd_rows()]), given):
        want = Counter()
        for doc_id, text in rows:
            w = (text or "").encode().split()
            want[doc_id, len(w), sum(greedy(b" " + x, known, longest) for x in w)] += 1
        assert Counter(map(tuple, token_counts.count_tokens(df, pieces).collect())) == want


def test_automaton_on_small_vocabularies():
    rng = np.random.default_rng(0)
    for _ in range(300):
        pieces = {bytes(rng.integers(97, 100, rng.integers(1, 6)).astype(np.uint8)) for _ in range(rng.integers(1, 12))}
        machine = token_counts.Automaton(pieces)
        for _ in range(40):
            word = bytes(rng.integers(97, 100, rng.integers(1, 12)).astype(np.uint8))
            assert machine.count(word) == greedy(word, pieces, 5), (pieces, word)


# ---- SimHash ---------------------------------------------------------------------------


def brute_fingerprint(text):
    w = [bytes(x) for x in (text or "").encode().lower().split()]
    runs = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    bits = [sum(xxhash.xxh64(r, seed=42).intdigest() >> b & 1 for r in runs) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(runs))


def brute_components(prints, max_bits):
    """Least id by repeated relaxation over all pairs."""
    values = sorted(set(prints.values()))
    least = {v: min(i for i, p in prints.items() if p == v) for v in values}
    moved = True
    near = [(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= max_bits]
    while moved:
        moved = False
        for a, b in near:
            low = min(least[a], least[b])
            moved |= least[a] != least[b]
            least[a] = least[b] = low
    return {i: least[p] for i, p in prints.items()}


def test_near_duplicates_of_given_documents(given):
    prints = {i: brute_fingerprint(t) for i, t in given[1]}
    want = brute_components(prints, 2)
    got = near_duplicates.classes(given[0]).collect()
    assert {r.doc_id: (r.node & (1 << 64) - 1, r.component_id) for r in got} == {i: (prints[i], want[i]) for i in prints}


def test_near_duplicates_of_odd_rows(docs, no_docs):
    got = near_duplicates.classes(docs).collect()
    assert len(got) == len(odd_rows())
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert {by_id[i].node for i in (4, 5, 6)} == {0} and {by_id[i].component_id for i in (4, 5, 6)} == {4}
    assert by_id[2].component_id == 1
    kept = near_duplicates.keep_one(docs)
    assert kept.columns == docs.columns
    counts = Counter(r.doc_id for r in kept.collect())
    assert counts[4] == 1 and counts[5] == counts[6] == counts[2] == 0 and counts[None] == 2 and counts[11] == 2 and counts[12] == 1
    assert near_duplicates.classes(no_docs).count() == 0 and near_duplicates.keep_one(no_docs).count() == 0


@pytest.mark.parametrize("max_bits", [0, 1, 2, 3])
def test_links_of_planted_fingerprints(spark, max_bits):
    """Chains, a dense cluster and strangers: the same components as all pairs give."""
    rng = np.random.default_rng(max_bits)
    values = set(map(int, rng.integers(0, 1 << 63, 60)))
    for start in list(values)[:12]:
        at = start
        for _ in range(6):
            for b in rng.choice(64, rng.integers(1, 4), replace=False):
                at ^= 1 << int(b)
            values.add(at)
    center = int(rng.integers(0, 1 << 63))
    values |= {center ^ 1 << a ^ 1 << b for a in range(0, 24, 2) for b in range(1, 24, 3)}
    signed = np.array(sorted(values), np.uint64).view(np.int64).tolist()
    printed = spark.createDataFrame([(i, 0, v) for i, v in enumerate(signed)], "doc_id long, tie long, node long")
    got = {r.node: r.label.doc_id for r in near_duplicates.components(printed, max_bits).collect()}
    want = brute_components({i: v & (1 << 64) - 1 for i, v in enumerate(signed)}, max_bits)
    assert got == {v: want[i] for i, v in enumerate(signed)}


def test_code_covers_all_words():
    code = Code(1)
    some = np.random.default_rng(0).integers(0, 1 << 63, 20_000).astype(np.uint64)
    anchors = code.anchor(some)
    assert np.bitwise_count(some ^ anchors).max() <= RADIUS
    assert (code.anchor(anchors) == anchors).all()
    row, found = code.anchors_around(some[:200])
    assert np.bitwise_count(some[row] ^ found).max() <= RADIUS + 2


# ---- quality classifier ------------------------------------------------------------------


def test_classifier_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op8_quality_classifier(spark, sf).collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    right = sum((s >= 0.5) == (q == 1) for s, q in held) / len(held)
    good = [s for s, q in held if q == 1]
    bad = [s for s, q in held if q == 0]
    assert right > 0.98 and sum(s >= 0.5 for s in good) / len(good) > 0.99 and sum(s < 0.5 for s in bad) / len(bad) > 0.9
    mean = sum(s for s, _ in held) / len(held)
    assert mean == pytest.approx(sum(q for _, q in held) / len(held), abs=0.03)


def test_classifier_on_odd_rows(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 1), (13, 0), (14, 0), (8, 1), (9, None), (99, 1), (None, 1)], "doc_id long, quality int")
    model = compression_quality.fit(docs, labels)
    scores = compression_quality.score(docs, model).collect()
    assert len(scores) == len(odd_rows()) and all(0 <= r.score <= 1 for r in scores)
    empty = {r.score for r in scores if r.doc_id in (4, 5)}
    assert len(empty) == 1
    kept = compression_quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.score >= 0.5 for r in scores)
    blank = compression_quality.fit(no_docs, labels.limit(0))
    assert {r.score for r in compression_quality.score(docs, blank).collect()} == {0.5}
    assert compression_quality.score(no_docs, model).count() == 0


# ---- token ids -----------------------------------------------------------------------------


def test_addressable_codes():
    rng = np.random.default_rng(0)
    for size in (0, 1, 7, 511, 512, 513, 5000):
        for top in (1, 255, 256, 49_408, 1 << 24, (1 << 32) - 1):
            ids = rng.integers(0, top, size, endpoint=True).astype(np.uint32)
            reader = addressable.Reader(addressable.encode(ids))
            assert (reader.slice(0, size) == ids).all()
            for _ in range(20 if size else 0):
                a, b = sorted(rng.integers(0, size + 1, 2))
                assert (reader.slice(int(a), int(b)) == ids[a:b]).all()
                at = int(rng.integers(0, size))
                assert reader[at] == ids[at]


def test_word_by_word_equals_whole_texts():
    """Random strings of hard characters have the ids that the tokenizer gives for the whole text."""
    from anualia.llm.token_output import WordEncoder

    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(0)
    hard = list("aBzİıſßẞΣςéÉ9²٣½.,!?'\"-–…<|>&@()[] \t\n") + ["e\u0301", "\u0307", "\u0338", "\u00a0", "\u3000", "ﬁ", "ǅ", "日", "🎉", "\u200d", "'s", "'ll", "Σ.", "İ.", "I\u0307!", "<|endoftext|>", "क्", "ㄱ", "ά;"]
    texts = ["".join(rng.choice(hard) for _ in range(rng.randint(1, 9))) for _ in range(50_000)] + ["BELGESİ.", "", None]
    encoder, tokenizer = WordEncoder(path, 2), Tokenizer.from_file(path)
    ids, sizes = (np.concatenate(x) for x in zip(*encoder.encode(pa.array(texts, pa.string()))))
    want = [[*e.ids, 2] for e in tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_other_tokenizers_encode_whole_texts():
    from anualia.llm.token_output import WordEncoder

    texts = ["It's  two  words.", "", None, "tab\tand É"]
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, tokenizer = WordEncoder(path, 7), Tokenizer.from_file(path)
    assert not encoder._by_word and WordEncoder(public_tokenizers.path("word_bpe_49k.json"), 2)._by_word
    ids = np.concatenate([i for i, _ in encoder.encode(pa.array(texts, pa.string()))]).tolist()
    assert ids == [i for t in texts for i in [*tokenizer.encode(t or "", add_special_tokens=False).ids, 7]]


def test_token_ids(spark, docs, given, no_docs):
    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    odd = [(r[0], r[1]) for r in odd_rows()]
    strange = [(900 + i, t) for i, t in enumerate([
        "it's we'll  a<|endoftext|>b <|startoftext|>", "é ́a ̈\ńb", "ΣΑΣ ΟΔΟΣ. İstanbul ﬁ", "a b c　d", "日本語 テスト 🎉🎉",
        "가 ᆨ", "x\x1cy\x85z ​", "12345 1 2 ３",
    ])]
    more = spark.createDataFrame(strange, "doc_id long, text string")
    for df, rows in ((docs, odd), given, (more, strange)):
        path = token_output.write_ids(df, queries.TOKENIZER, 2)
        got = sorted(map(tuple, token_output.read_documents(spark, path).collect()), key=lambda r: r[1])
        assert [r[0] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
        ids = {}
        for i, t in rows:
            found = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
            ids.setdefault(i, set()).add((len(found), zlib.crc32(np.array(found, "<u4").tobytes())))
        start = 0
        for doc_id, at, n, crc in got:
            assert at == start and (n, crc) in ids[doc_id]
            start += n
    empty = token_output.write_ids(no_docs, queries.TOKENIZER, 2)
    assert token_output.read_documents(spark, empty).count() == 0

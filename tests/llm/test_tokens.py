"""Token files, divergence of sources and alignment of tokenizers, against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from kindred.llm import _tokens, token_files
from kindred.llm import alignment as al
from kindred.llm._words import words
from kindred.llm.alignment import alignment_report
from kindred.llm.divergence import divergence
from kindred.llm.token_files import decode, expand, expand_range, new_folder, read_ranges, repair, write_tokens

ODD = [
    None, "", "a", " ", "  x", "  a  b\n\nc", "\nE", "a\nB", "a \n b.\nC", "▁x a", "x▁y", "x<|endoftext|>y <s>", "a <|endoftext|> b", "naïve café — ﬁn　y  z", "é o",
    "日本語 テキスト x", "a\x00b", "it's  the end.\nThe \"end\"", "\t tab", "aaaa" * 500, "\U0001f600 \U0001f600\U0001f600 x", "\r\n a", "word,word;word|x| y", "1 2  33 $$$ '''s 't", "a b " * 3000,
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    both = [Tokenizer.from_file(_tokens.vocabulary("byte_bpe_50k.json")) for _ in range(2)]
    for plain, own in enumerate(both):
        own.encode_special_tokens = bool(plain)
    return both.__getitem__


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=_tokens.vocabulary("piece_bpe_32k.model"))


def source(name):
    with open(_tokens.vocabulary(name), "rb") as f:
        return f.read()


def buffers(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def documents(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(st.sampled_from("abcAB '.,|\n\t\r$1 é　’<>▁")), max_size=6))
def test_pieces_encode_as_whole_texts_do(tokenizer, pieces, texts):
    whole = tokenizer(False)
    ids, cut = _tokens.byte_level(source("byte_bpe_50k.json"), False).ids(*buffers(texts))
    assert [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    spaced = [" " + t for t in texts if t]
    ids, cut = _tokens.piece_level(source("piece_bpe_32k.model")).ids(*buffers(spaced))
    assert [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)] == [pieces.encode(t[1:]) for t in spaced]


def test_encoder_forgets_and_still_encodes(tokenizer, monkeypatch):
    monkeypatch.setattr(_tokens, "KNOWN", 3)
    encoder = _tokens.Encoder(lambda x: [t.ids for t in tokenizer(False).encode_batch(x, add_special_tokens=False)], True)
    for texts in (["one two three"], ["four five", "one two"], ["", "six"]):
        ids, cut = encoder.ids(*buffers(texts))
        assert [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)] == [tokenizer(False).encode(t).ids for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=60), min_size=1, max_size=8), st.integers(0, 300), st.integers(1, 60))
def test_grammar_round_trip(docs, start, n):
    ids = np.array([x for d in docs for x in [*d, 0]] * 3, np.int32)
    ends = np.cumsum([len(d) + 1 for d in docs] * 3)
    terminals, rules, lengths, symbols, cut = repair(ids, ends)
    assert np.array_equal(expand(symbols, terminals, rules, lengths), ids)
    assert lengths[symbols].sum() == len(ids) and len(cut) == len(ends)
    # a document's symbols expand to its own ids
    upto = np.cumsum(lengths[symbols])
    assert upto[cut - 1].tolist() == ends.tolist()
    start %= len(ids)
    n = min(n, len(ids) - start)
    assert np.array_equal(expand_range(symbols, terminals, rules, lengths, start, n), ids[start : start + n])


def test_grammar_shortens_what_repeats():
    ids = np.array(([5, 6, 7, 8, 9, 0] * 400) + [4] * 3000 + [0], np.int32)
    ends = np.array([*range(6, 2401, 6), len(ids)])
    terminals, rules, lengths, symbols, _ = repair(ids, ends)
    assert len(symbols) < len(ids) / 3 and len(rules) > 2 and np.array_equal(expand(symbols, terminals, rules, lengths), ids)


def by_doc(rows):
    """Rows in the order of the files."""
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))


def test_token_files(spark, tokenizer, monkeypatch):
    rows = [(i * 3 % 50, t) for i, t in enumerate(ODD)] + [(None, "no id"), (None, "no id"), (7000, "same id"), (7000, "same id"), (7000, None), (-4, "x " * 20000)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id int, text string, ids int, first int").repartition(5)
    folder = new_folder(docs)
    write_tokens(docs, folder, shard_ids=300)
    got = decode(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == [r[0] for r in by_doc(rows)]
    start = 0
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert (r.start, r.n_tokens) == (start, len(ids)) and ids[-1] == 0
        start += len(ids)
    want = Counter((d, tuple([*tokenizer(False).encode(t or "", add_special_tokens=False).ids, 0])) for d, t in rows)
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    assert spark.read.parquet(f"{folder}/shards").count() > 3

    # ranges across documents and shards, beyond both ends, and of no id
    whole = np.concatenate([np.frombuffer(r.ids, "<u4") for r in got])
    asked = [(1, 0, 5), (2, 250, 700), (3, len(whole) - 3, 50), (4, -2, 4), (5, 10, 0), (6, len(whole) + 5, 9), (7, 0, len(whole))]
    ranges = {r.request: np.frombuffer(r.ids, "<u4").tolist() for r in read_ranges(spark, folder, spark.createDataFrame(asked, "request long, start long, n long"), shard_ids=300).collect()}
    assert ranges == {k: whole[max(a, 0) : max(a + n, 0)].tolist() for k, a, n in asked if k not in (5, 6)}


def test_token_files_of_an_empty_table(spark):
    docs = documents(spark, [])
    folder = new_folder(docs)
    write_tokens(docs, folder)
    assert decode(spark, folder).count() == 0


def test_token_query(spark, tokenizer):
    from kindred.llm.queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    start, want = 0, []
    for r in docs:
        ids = np.array([*tokenizer(False).encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in QUERIES["op11_token_files"](spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()] == want


def test_words_of_weak_hashes_differ():
    a = "a"
    while len(a) < 1024:
        a += a.translate(str.maketrans("ab", "ba"))
    texts = [a, a.translate(str.maketrans("ab", "ba")), a[:512], a * 3, a * 3 + "b", "a" * 511, "a" * 512, "a" * 513, "ab", "a\x00b", "ba", "b", "abcdefgh", "abcdefghi"]
    assert len(set(words(*buffers(texts)).hash.tolist())) == len(texts)


def brute_divergence(rows, least, ranks):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = [("".join(c if c.isascii() and c.isalpha() or ord(c) > 127 else " " for c in t or "").translate(low).split(" "), la or "", s or "") for t, la, s in rows]
    docs, counts, groups = defaultdict(int), defaultdict(Counter), set()
    for terms, lang, src in rows:
        groups.add((lang, src))
        for t in {t for t in terms if t}:
            docs[lang, t] += 1
        counts[lang, src].update(t for t in terms if t)
    out = []
    for lang, src in groups:
        kept = [t for (la, t), n in docs.items() if la == lang and n >= least]

        def p(count, kept=kept):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (n + len(kept)) for t in kept}

        def f(a, b):
            return (a - b) ** 2 // b

        own, whole = p(counts[lang, src]), p(sum((c for (la, _), c in counts.items() if la == lang), Counter()))
        pair = [(sum(f(own[t], q[t]) for t in kept), s) for la, s in groups if la == lang and s != src for q in [p(counts[la, s])]]
        term = [(f(own[t], whole[t]), t) for t in kept if counts[lang, src][t] and own[t] > whole[t]]
        for part, items, most in (("pair", pair, None), ("term", term, ranks)):
            out += [(lang, src, part, item, v, i + 1, len(kept)) for i, (v, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most])]
    return sorted(out)


def test_divergence(spark, monkeypatch):
    import kindred.llm.divergence as dv

    rng = np.random.default_rng(4)
    terms = [*"abcdefghij", "été", "ａ", "\U00010400x", "Zz", "don't", "x9y"]
    rows = [(" ".join(rng.choice(terms, rng.integers(0, 30))), str(rng.choice(["en", "de"])), f"s{rng.integers(0, 5)}") for _ in range(200)]
    rows += [(None, None, None), ("", "en", "void"), ("A a a", None, None), ("only", "xx", "one"), ("other", "xx", "two"), ("a", "fr", "one"), ("a b", "fr", "one"), ("a c", "fr", "one"), ("long " * 30000, "en", "s0")]
    want = brute_divergence(rows, 3, 4)
    docs = documents(spark, [(1, *r, "x", 5) for r in rows], "doc_id long, text string, lang string, source string, item string, count int").repartition(3)
    for bits, held, pairs, few in ((64, 1 << 20, 1 << 20, 100), (2, 1 << 20, 1 << 20, 100), (1, 5, 7, 0)):
        for name, value in (("HELD", held), ("PAIRS", pairs), ("FEW_GROUPS", few)):
            monkeypatch.setattr(dv, name, value)
        assert sorted(map(tuple, divergence(docs, 3, 4, bits).collect())) == want
    assert divergence(docs.where("false"), 3, 4).count() == 0


def test_divergence_of_counts_beyond_64_bits(spark):
    # the product of a count and the scale is beyond 64 bits from some 9.2e9 occurrences on
    from kindred.llm.divergence import _p

    n = 20_000_000_000
    got = spark.createDataFrame([(n, 3 * n, 7)], "count long, n long, v long").selectExpr(_p("count", "n")).first()[0]
    assert got == 1 + 10**9 * (n + 1) // (3 * n + 7)


def brute_alignment(texts, tokenizer, pieces):
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    table |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    out, held = [], Counter()
    for t in texts:
        want = (" " + (t or "")).encode()
        a, b = (tokenizer.encode(" " + t, add_special_tokens=False).ids, pieces.encode(t)) if t else ([], [])
        bytes_a = [bytes(table[c] for c in tokenizer.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not t or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            out.append(([], [], [], []))
            continue
        at_a, at_b = ([i for i, x in enumerate(xs) for _ in x] for xs in (bytes_a, bytes_b))
        links = sorted(set(zip(at_a, at_b, strict=True)))
        ends = sorted(set(np.cumsum([len(x) for x in bytes_a])) & set(np.cumsum([len(x) for x in bytes_b])))
        groups, lo = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(ids[i]) for i in sorted(set(at[lo:e]))) for ids, at in ((a, at_a), (b, at_b))))
            lo = e
        links = [(a[i], b[j]) for i, j in links]
        held.update(set(links))
        out.append((a, b, groups, links))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    return [
        (len(a), len(b), len(g), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for a, b, g, links in out
    ]


@pytest.mark.parametrize("hot", [1 << 17, 40, 1])
def test_alignment(spark, tokenizer, pieces, monkeypatch, hot):
    monkeypatch.setattr(al, "HOT", hot)
    monkeypatch.setattr(al, "PIECE_BYTES", 2000)
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs = documents(spark, [(i, t, 3, [1]) for i, t in enumerate(texts)], "doc_id int, text string, row int, pairs array<int>").repartition(3)
    got = [tuple(r)[1:] for r in alignment_report(docs).orderBy("doc_id").collect()]
    assert got == brute_alignment(texts, tokenizer(True), pieces)


def test_alignment_of_rows_without_ids_and_of_empty_tables(spark):
    docs = documents(spark, [(None, "a b"), (None, "a b"), (3, "a b"), (3, None)])
    got = sorted((r.doc_id or 0, r.n_links, r.count_sum) for r in alignment_report(docs).collect())
    assert got == [(0, 2, 6), (0, 2, 6), (3, 0, 0), (3, 2, 6)]
    assert alignment_report(docs.where("false")).count() == 0

"""The conversation trie, spelling variants and token counts against brute force, and long texts in parts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import registry, spelling, token_counts, tokens
from tidemark.llm.conversation_trie import conversation_trie
from tidemark.llm.langid import identify, learn_filter

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_trie(rows, heads):
    """Nodes of rows (conv, turn, role, text) with repeated turns in the order given by their digests."""
    digest = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).digest()
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, digest(role, text), role, text))
    plain = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    seqs = {c: tuple(plain.get(c - c % 20, [])[: heads(c)] + v[heads(c) :]) for c, v in plain.items()}
    members = defaultdict(list)
    for c in sorted(seqs):
        for d in range(len(seqs[c]) + 1):
            members[seqs[c][:d]].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    out, total = [], {}
    for k in sorted(members, key=len, reverse=True):
        saved = (len(members[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        total[k] = (sum(total[c][0] for c in children[k]) or 1, saved + sum(total[c][1] for c in children[k]))
        ends = ",".join(str(c) for c in members[k] if len(seqs[c]) == len(k))
        out.append((members[k][0], len(k), members[k[:-1]][0] if k else None, len(members[k]), len(children[k]), *total[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_rows(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


CONVS = "conv_id bigint, turn int, role string, text string"


def odd_conversations():
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", None, ""]), r.choice(["a b", "a  b\t", None, "", "x"])) for c in range(150) for t in range(r.randrange(1, 5))]
    rows += [(c, None if i == 2 else i, "user", f"w {i}" + " v" * (i % 3)) for c in (200, 201, 240, 261, 300) for i in range(6 + (c > 250))]  # long, and copies
    rows += [(c, i, "user", "same words here") for c in range(400, 520) for i in range(3)]  # a crowd of copies
    return rows + rows[5:9] + [(None, 0, "user", "lost"), (23, 0, "user", "a"), (7001, 0, "user", "only")]


@pytest.mark.parametrize("heads", [None, "crc"])
def test_op11_odd_rows(spark, heads):
    rows = odd_conversations()
    df = spark.createDataFrame(rows, CONVS).repartition(7).withColumns({c: F.lit(1) for c in ("conv", "digest", "words", "pos", "node", "range")})
    column = F.crc32(F.col("conv").cast("string").cast("binary")) % 4 if heads else None
    assert trie_rows(conversation_trie(df, column)) == brute_trie(rows, (lambda c: zlib.crc32(str(c).encode()) % 4) if heads else lambda c: 0)


def test_op11(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert trie_rows(registry.queries()["op11_conversation_trie"](spark, SF)) == brute_trie(rows, lambda c: zlib.crc32(str(c).encode()) % 4)


def test_op11_empty_and_lists_in_chunks(spark, monkeypatch):
    assert conversation_trie(spark.createDataFrame([], CONVS)).count() == 0
    from tidemark.llm import conversation_trie as module

    monkeypatch.setattr(module, "CHUNK", 7)
    monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    rows = [(c, t, "user", "w" * t) for c in range(300) for t in range(2)] + [(1000, t, "user", str(t)) for t in range(500)]
    assert trie_rows(conversation_trie(spark.createDataFrame(rows, CONVS))) == brute_trie(rows, lambda c: 0)


def brute_words(docs, least_n=3):
    count = Counter()
    for d, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{d}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    return {w: n for w, n in count.items() if n >= least_n and len(w) >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words):
    out, form = [], {}
    near = {w: [v for v in words if v != w and one_edit(v, w)] for w in words}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 2 * n:
            form[w] = best
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out)


def variant_rows(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_op12(spark, tmp_path):
    r = random.Random(2)
    stems = ["maison", "straße", "aaaaa", "aaaaaa", "aaaab", "éàüöÿ", "éàüöÿÿ", "hello"]
    mangled = lambda w: r.choice([w, w, w, w[:-1], w + w[-1], w[:2] + r.choice("abéÀ×") + w[3:], w.upper()])
    docs = [(i, " ".join(mangled(r.choice(stems)) for _ in range(60))) for i in range(40)] + [(None, "lorem lorem lorem"), (41, None), (42, ""), (43, "x" * 3000 + " " + "x" * 2999), (44, "1234 中文中文中文 ab"), (45, "word " * 500 + "words words words")]
    spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("id", "n", "word")}).write.parquet(f"{tmp_path}/documents.parquet")
    words = brute_words([("" if d is None else d, t) for d, t in docs])
    assert variant_rows(registry.queries()["op12_spelling_variants"](spark, str(tmp_path))) == brute_variants(words)


def test_op12_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    words = brute_words(docs)
    got = variant_rows(registry.queries()["op12_spelling_variants"](spark, SF))
    assert [(r[0], r[3]) for r in got] == sorted(words.items())
    by = {r[0]: r for r in got}
    for w in random.Random(1).sample(sorted(words), 60):
        near = [v for v in words if one_edit(v, w) and v != w]
        assert by[w][4] == len(near)
        best = min(near, key=lambda v: (-words[v], v), default=None)
        assert by[w][1] == (best if best and words[best] >= 2 * words[w] else None)
        root = w
        while by[root][1]:
            root = by[root][1]
        assert by[w][2] == root


def test_op12_neighbourhood_is_whole_and_distinct():
    """With a filter that lets all through, all distinct deletions, replacements and insertions come out, once each."""
    alphabet = np.array([97, 98, 233], np.uint8)

    class All:
        def has(self, h):
            return np.arange(len(h))

    for word in ("a", "aab", "abé", "ébbba"):
        letters = next(spelling.by_length([word]))
        rows, found = spelling.neighbours(letters, alphabet, All())
        want = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[j:] for i in range(len(word) + 1) for j in (i, i + 1) if j <= len(word) for c in "abé"}
        assert sorted(found) == sorted(want - {word}) and set(rows) == {0}


def test_op12_filter_misses_no_word(spark, monkeypatch):
    monkeypatch.setattr(spelling, "MOST_BITS", 1 << 18)
    words = ["".join(random.Random(i).choices("abcdéÿ", k=5 + i % 9)) for i in range(30_000)]
    known = spelling.word_filter(spark.createDataFrame([(w,) for w in set(words)], "word string"))
    for letters in spelling.by_length(words):
        assert len(known.has(spelling.hashes(letters))) == len(letters)


def test_op12_long_texts_in_parts(monkeypatch):
    text = "Maison, élève; " * 50 + "z" * 400
    whole = [w for found in spelling.runs(text, 5) for w in found]
    monkeypatch.setattr(spelling, "PART", 7)
    assert [w for found in spelling.runs(text, 5) for w in found] == whole and whole[-1] == "z" * 400


ALPHABET = "aaaab'stre  \n\t\r12é中文😀.,!-_。，\x1c　\xa0<|>"


def random_texts(n, seed):
    r = random.Random(seed)
    special = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", ""]
    return ["".join(r.choice(ALPHABET) for _ in range(r.randrange(60))) + r.choice(special) + "a" * r.randrange(20) + " <|endoftext|>" * r.randrange(2) for _ in range(n)]


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(registry.vocabulary(name))


def test_op13(spark, tmp_path):
    odd = [None, "", " ", "\n\n", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "word " * 4000, "é" * 3000, "中文。" * 900, *random_texts(300, 1)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + [(10_000 + i, t) for i, t in enumerate(odd)] + [(None, "no id"), (3, "repeated id")]
    spark.createDataFrame(rows, docs.schema).withColumns({c: F.lit("clash") for c in ("n_tokens", "N_Bytes", "ids")}).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in registry.queries()["op13_token_counts"](spark, str(tmp_path)).collect())
    n = [len(e.ids) for e in library("byte_bpe_50k.json").encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    assert got == Counter((d, len((t or "").encode()), k, k > 512) for (d, t), k in zip(rows, n, strict=True))


@pytest.mark.parametrize("part", [3, 17, 1 << 18])
@pytest.mark.parametrize("ordered", [True, False])
def test_op13_parts_and_merges(monkeypatch, part, ordered):
    """Texts in parts of any size, pairs one by one and all at once, small and large tables: always the library's counts."""
    counter = token_counts.TokenCounter(registry.vocabulary("byte_bpe_50k.json"))
    assert counter.merges.ordered
    monkeypatch.setattr(counter.merges, "ordered", ordered)
    monkeypatch.setattr(counter, "table", {})
    monkeypatch.setattr(token_counts, "TABLE_ENTRIES", 50)
    monkeypatch.setattr(token_counts, "RAGGED", 40)
    monkeypatch.setattr(tokens.parts, "__defaults__", (part,))
    monkeypatch.setattr(token_counts.pieces_of, "__defaults__", (part,))
    texts = random_texts(1500, part)
    assert counter.counts([*texts, None]).tolist() == [*(len(e.ids) for e in library("byte_bpe_50k.json").encode_batch(texts, add_special_tokens=False)), 0]


@pytest.mark.parametrize("name,lower", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
@pytest.mark.parametrize("part", [5, 1 << 18])
def test_encoders_in_parts_with_special_tokens(monkeypatch, name, lower, part):
    monkeypatch.setattr(tokens.parts, "__defaults__", (part,))
    encoder, texts = tokens.hub_encoder(registry.vocabulary(name), lower), random_texts(3000, 7)
    for text, e in zip(texts, library(name).encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == e.ids


def test_parts_are_bounded():
    for text in ("mot après mot " * 40_000, "中文，没有空格。" * 60_000):
        found = list(tokens.parts(text))
        assert "".join(found) == text and max(map(len, found)) < tokens.PART + 100 and len(found) > 1


def test_op6_language_of_empty_texts_alone(spark):
    """A language whose only training text is empty, and an empty text behind a block that filled up."""
    rows = [(1, "", "de"), (2, "hello world and more words", "en"), (3, "palabras " * 200_000, "es"), (4, "", "es")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").coalesce(1)
    got = {r["doc_id"]: r["lang_pred"] for r in identify(docs, learn_filter(docs, F.lit(True))).collect()}
    assert got[1] == got[4] == "und" and got[3] == "es"


@pytest.mark.parametrize("owners", [700, 450])
def test_op1_windows(monkeypatch, owners):
    """Each owner meets the WINDOW rows after it and its whole group, and nothing else, whatever the blocks."""
    from tidemark.llm import embedding_dedup as dedup

    monkeypatch.setattr(dedup, "BLOCK", 50)
    r = np.random.default_rng(1)
    x = r.standard_normal((700, 3))
    x /= np.linalg.norm(x, axis=1)[:, None]
    group = np.sort(np.concatenate([np.full(150, 7), r.integers(0, 60, 550)]))
    ids = r.permutation(700)
    a, b = dedup.window_links(ids, group, x, 0.99, owners)
    at = np.argsort(ids)
    meet = lambda i, j: i < owners and (j - i <= dedup.WINDOW or group[i] == group[j])
    links = [(i, j) for i in range(700) for j in range(i + 1, 700) if meet(i, j) and x[i] @ x[j] >= 0.99]

    def classes(pairs):
        up = list(range(700))
        find = lambda k: k if up[k] == k else find(up[k])
        for i, j in pairs:
            up[find(i)] = find(j)
        return {frozenset(k for k in range(700) if find(k) == top) for top in {find(k) for k in range(700)}}

    assert classes(links) == classes(zip(at[a].tolist(), at[b].tolist(), strict=True))

"""Token alignment against a plain one, token by token, by the libraries that name the ids."""

import hashlib
from collections import Counter

import pytest

from tessera.llm import align
from tessera.llm.queries import op13_token_alignment
from tessera.sources.tables import load

SCHEMA = "doc_id long, text string, copies long, sha string"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = ["Hello  world\n\n\tfoo", "naïve café ß Ünïcödé 你好 🙂🙂", "a▁b", "\x00 nul", " lead", "trail ", "<|endoftext|> <s></s><unk> <0x41>",
         "de den der " * 300, "x", " ", "\n", None, "", "ﬁ ½ Å", "é", "1234567 1,000.00", "tab\tand\r\nline"]


@pytest.fixture(scope="module")
def tools():
    import public_tokenizers as p
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    codes = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    rest = [c for c in range(256) if c not in codes]
    chars = {chr(c): c for c in codes} | {chr(256 + i): c for i, c in enumerate(rest)}
    return a, chars, sentencepiece.SentencePieceProcessor(model_file=p.path("piece_bpe_32k.model"))


def _tokens(text, tools):
    a, chars, b = tools
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    bytes_a = [bytes(chars[c] for c in a.id_to_token(i)) for i in ids_a]
    ids_b = b.encode(text)
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
               for i in ids_b for p in [b.id_to_piece(i)]]
    whole = (" " + text).encode()
    return (ids_a, bytes_a, ids_b, bytes_b) if b"".join(bytes_a) == whole == b"".join(bytes_b) else None


def _spans(pieces):
    at, out = 0, []
    for p in pieces:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def _brute(docs, tools):
    per, counts = [], Counter()
    for i, text in docs:
        found = _tokens(text, tools) if text else None
        if not found:
            per.append((i, None))
            continue
        ids_a, bytes_a, ids_b, bytes_b = found
        sa, sb = _spans(bytes_a), _spans(bytes_b)
        links = [(ids_a[x], ids_b[y]) for x, (s, e) in enumerate(sa) for y, (t, f) in enumerate(sb) if s < f and t < e]
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, low = [], 0
        for c in cuts:
            groups.append(",".join(str(n) for n, (s, e) in zip(ids_a, sa) if low <= s and e <= c) + "|"
                          + ",".join(str(n) for n, (s, e) in zip(ids_b, sb) if low <= s and e <= c))
            low = c
        counts.update(set(links))
        per.append((i, (len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())))
    top = {}
    for (a, _), n in counts.items():
        top[a] = max(top.get(a, 0), n)
    return Counter((i, 0, 0, 0, 0, 0, 0, "") if r is None else
                   (i, r[0], r[1], r[2], len(r[3]), sum(counts[p] == top[p[0]] for p in r[3]), sum(counts[p] for p in r[3]), r[4])
                   for i, r in per)


def _run(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in align.align_documents(df).collect())


def test_matches_brute_force_and_blocks(spark, tools, monkeypatch):
    docs = [(i, t) for i, t in enumerate(TEXTS * 2)] + [(None, "x"), (3, "again"), (3, "again")]
    df = spark.createDataFrame([(i, t, None, "clash") for i, t in docs], SCHEMA).repartition(5)
    want = _brute(docs, tools)
    assert _run(df) == want
    monkeypatch.setattr(align, "BLOCK_PAIRS", 7)  # many broadcasts
    monkeypatch.setattr(align, "HOT_COPIES", 1)  # copies by broadcast, the rest by shuffle
    assert len(align._blocks(spark.createDataFrame([(1,)] * 8 + [(2,)] * 3, "a int"))) == 2
    assert _run(df) == want


def test_given_documents(spark, tools):
    docs = load(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect() if r.text is None or len(r.text) < 3000]
    df = spark.createDataFrame([(i, t, 1, "") for i, t in rows], SCHEMA)
    assert _run(df) == _brute(rows, tools)
    assert op13_token_alignment(spark, "/root/testdata/sf0.001").count() == docs.count()


def test_many_copies(spark, tools):
    docs = [(i, "the same text") for i in range(3000)] + [(5000 + i, f"other {i}") for i in range(50)]
    assert _run(spark.createDataFrame([(i, t, 1, "") for i, t in docs], SCHEMA).repartition(4)) == _brute(docs, tools)


def test_empty_table(spark):
    assert _run(spark.createDataFrame([], SCHEMA)) == Counter()
    assert _run(spark.createDataFrame([(1, None, 1, ""), (2, "", 1, "")], SCHEMA)) == Counter(
        [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")])


def test_very_long_texts(spark):
    """A run of a million spaces (where the fast matcher gives up), letters and words: bytes are covered, nothing is cut."""
    texts = ["a" + " " * 1_000_000 + "b", "a" * 300_000, "ab cd " * 100_000]
    rows = {r.doc_id: r for r in align.align_documents(
        spark.createDataFrame([(i, t, 1, "") for i, t in enumerate(texts)], SCHEMA)).collect()}
    for r in rows.values():
        assert r.n_links == r.n_a + r.n_b - r.n_groups > 1000

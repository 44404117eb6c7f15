"""SentencePiece encoding, token counts and token files against the tokenizer libraries."""

import io
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from llm_helpers import prose
from tokenizers import Tokenizer

from graphloom.llm import common, sentencepiece as sp, token_counts, token_files
from graphloom.llm.forward import Forward
from graphloom.llm.pieces import load

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "a", "  a  b ", "Hello, world! It's 2024-01-01...", "naïve café 😀😀 日本語 テキスト", "x\ny\n\nz", "\n", " \nx", "tab\there",
    "aaaaaaaaaaaaaaaaaaaaaaaa", "    def f(x):\n        return x**2", "WORD!! WORD### word$$$ word,", "a\xa0b c　d", prose(3, 300), "a▁b",
]


@pytest.fixture(scope="module")
def unigram_path(tmp_path_factory):
    """The same pieces as a unigram model, its white-space runs with a score that single precision holds."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(open(PATH, "rb").read())
    m.trainer_spec.model_type = 1
    for p in m.pieces:
        if p.score < -1e8:
            p.score = -40000.0
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(m.SerializeToString())
    return str(path)


def arrow(texts):
    return pa.array(texts, pa.string())


def rows_of(found):
    ids, ends = found
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]


def random_texts(seed, n):
    """Texts of syllables, marks, digits, odd white space and rare characters."""
    rng = random.Random(seed)
    units = ["the", "ing", "o", "é", "ß", "7", "42", ".", ",", ".,", "'s", "-", "日", "😀", "\u0301", "▁", "𝔘", "Q"]
    gaps = [" "] * 12 + ["\n", "  ", "\t", " \n", "\xa0", "\u3000", "\r\n", "\x1c", "\0"]
    plain = [" "] * 12 + ["\n"]
    out = []
    for _ in range(n):
        between = rng.choice((gaps, plain))
        out.append("".join("".join(rng.choices(units, k=rng.randint(1, 5))) + rng.choice(between) for _ in range(rng.randint(0, 12))))
    return out


def test_merged_pieces_equal_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = TEXTS + random_texts(1, 3000)
    (found,), back = sp.Encoder(load(PATH)).encode(arrow(texts), check=True)
    # the mark itself comes back as a space
    assert back.tolist() == ["▁" not in (t or "") for t in texts]
    for text, got in zip(texts, rows_of(found)):
        assert got == library.encode(text or ""), text
        assert load(PATH).decode(got) == library.decode(got)


def test_viterbi_equals_the_library_word_by_word(unigram_path):
    library = sentencepiece.SentencePieceProcessor(model_file=unigram_path)
    words = sorted({w for t in TEXTS + random_texts(2, 500) for w in (t or "").split()} | {"Steser", "enaich.", "𝔘𝔫", "é"})
    model = load(unigram_path)
    assert model.reading == "unigram"
    (found,), _ = sp.Encoder(model).encode(arrow(words))
    assert rows_of(found) == [library.encode(w) for w in words]


def test_unknown_characters_without_bytes(tmp_path):
    """A vocabulary without byte pieces has one unknown id for a run of unknown characters, and does not spell it."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    for kind in (1, 2):
        m = pb.ModelProto()
        m.ParseFromString(open(PATH, "rb").read())
        m.trainer_spec.model_type, m.trainer_spec.byte_fallback = kind, False
        kept = [p for p in m.pieces if p.type != pb.ModelProto.SentencePiece.BYTE and (p.score > -1e8 or p.piece == "▁")]
        del m.pieces[:]
        m.pieces.extend(kept)
        path = tmp_path / f"{kind}.model"
        path.write_bytes(m.SerializeToString())
        library = sentencepiece.SentencePieceProcessor(model_file=str(path))
        texts = ["a😀😀b", "😀", "x\ny", "日本語😀 日", "plain words here", ""]
        model = load(str(path))
        (found,), back = sp.Encoder(model).encode(arrow(texts), check=True)
        assert rows_of(found) == [library.encode(t) for t in texts], kind
        assert back.tolist() == [library.decode(library.encode(t)) == t for t in texts]
        (counts,) = token_counts.Counter(model).counts(arrow(texts))
        assert counts.tolist() == [len(library.encode(t)) for t in texts]


def test_both_readings_in_one_walk_equal_each_alone():
    model, texts = load(PATH), arrow(TEXTS + random_texts(3, 400))
    (merged, best), _ = sp.Encoder(model, "bpe", "unigram").encode(texts)
    assert rows_of(merged) == rows_of(sp.Encoder(model, "bpe").encode(texts)[0][0])
    assert rows_of(best) == rows_of(sp.Encoder(model, "unigram").encode(texts)[0][0])
    for reading, found in (("bpe", merged), ("unigram", best)):
        (counts,) = token_counts.Counter(model, reading).counts(texts)
        assert counts.tolist() == [len(x) for x in rows_of(found)]


def test_words_that_were_forgotten_are_learnt_again(monkeypatch):
    for module in (sp, token_counts, token_files):
        monkeypatch.setattr(module, "REMEMBERED", 40)
    model, texts = load(PATH), [prose(k, 60) for k in range(12)] * 2
    encoder, counter, tokens = sp.Encoder(model), token_counts.Counter(model), token_files.Tokens(PLAIN_PATH)
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text in texts:
        (found,), _ = encoder.encode(arrow([text]))
        assert rows_of(found) == [library.encode(text)]
        assert counter.counts(arrow([text]))[0].tolist() == [len(library.encode(text))]
        assert rows_of(tokens.encode(arrow([text]))) == [plain(text)]


def best_score(model, word):
    """(score, pieces) of the best path, by trying every split of the word."""
    tops = [(0.0, 0)]
    for stop in range(1, len(word) + 1):
        ways = [(tops[a][0] + model.scores[model.ids[word[a:stop]]], tops[a][1] + 1) for a in range(stop) if word[a:stop] in model.ids]
        tops.append(max(ways, key=lambda w: w[0], default=(float("-inf"), 0)))
    return tops[-1]


def test_viterbi_scores_equal_brute_force():
    model = load(PATH)
    words = sorted({f"▁{w}" for w in prose(5, 200).split()} | {"▁international", "▁", "▁xylophone.,"})
    for word, ids, _ in Forward(model, ("unigram",)).walk(words):
        pieces = np.frombuffer(ids, "<i4").tolist()
        assert "".join(model.surface[i] for i in pieces) == word
        assert sum(model.scores[i] for i in pieces) == best_score(model, word)[0]


def merged(model, text):
    """Merging by its definition: the best-scored neighbours, the leftmost of equals, until none is left."""
    parts = list(text)
    while True:
        ways = [(-model.scores[model.ids[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in model.ids]
        if not ways:
            return parts
        k = min(ways)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_pieces_stand_as_merging_leaves_them():
    model, rng = load(PATH), random.Random(4)
    ids = list(model.ids.values())
    short = [i for i in ids if len(model.surface[i]) < 4 and model.surface[i].isascii()]
    for n in range(4000):
        pool = short if n % 2 else ids
        left, right = rng.choice(pool) if n % 9 else -1, rng.choice(pool)
        pair = [model.surface[i] for i in (left, right) if i >= 0]
        assert model.stand(left, right) == (merged(model, "".join(pair)) == pair), pair


def test_shared_prefixes_change_nothing():
    words = sorted(["▁inter", "▁internal", "▁international", "▁internet", "▁x", "▁xylophone"])
    walker = Forward(load(PATH), ("unigram", "bpe"))
    together = list(walker.walk(words))
    assert together == [x for w in words for x in walker.walk([w])]


def test_memory_of_words_is_bounded(monkeypatch):
    cache = common.Remembered(3)
    for k in range(20):
        new = cache.missing({k, 0})
        cache.young.update((w, w * w) for w in new)
        assert cache.young[0] == 0 and len(cache.young) + len(cache.old) <= 10


def test_encode_decode_frames(odd_docs, no_docs):
    rows = sp.decode(sp.encode(odd_docs), out_col="back").join(odd_docs.select("doc_id", "text").distinct(), "doc_id").collect()
    assert rows and all(r.back == (r.text or "") for r in rows)
    d = {r.doc_id: r for r in sp.digests(odd_docs).collect()}
    assert all(r.round_trip for r in d.values())
    assert (d[5].n_ids, d[5].ids_crc32, d[6].viterbi_n) == (0, 0, 0)
    c = {r.doc_id: r for r in token_counts.token_counts(odd_docs).collect()}
    ids = {r.doc_id: r.ids for r in sp.encode(odd_docs).collect()}
    assert {k: r.ids for k, r in d.items()} == ids
    assert {k: (r.n_tokens, r.n_viterbi) for k, r in c.items()} == {k: (r.n_ids, r.viterbi_n) for k, r in d.items()}
    for f in (sp.encode, sp.digests, token_counts.token_counts):
        assert f(no_docs).count() == 0


def plain(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


PLAIN_PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PLAIN_PATH)
MORE = ["<|endoftext|> in a text", "a \nb", "a\n b", "don't 'tis we'll", " lead", "trail ", "\x1c x\x1cy", "a\r\nb", "l1\nl2\nl3", "mark.\nNext"]


def test_byte_tokens_equal_the_library():
    tokens = token_files.Tokens(PLAIN_PATH)
    texts = TEXTS + MORE + random_texts(6, 3000)
    for _ in range(2):  # the second time from memory
        for text, got in zip(texts, rows_of(tokens.encode(arrow(texts)))):
            assert got == plain(text), text


def test_remembered_pieces_take_few_bytes():
    """So a worker can remember enough of them; as Python strings and bytes they took over 100 bytes each."""
    tokens = token_files.Tokens(PLAIN_PATH)
    tokens.encode(arrow(["a b"]))
    rng = random.Random(8)
    words = sorted({"".join(rng.choices(["ther", "in", "que", "lo", "sch", "ä", "z"], k=5)) for _ in range(30_000)})
    tracemalloc.start()
    try:
        before, column = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes(), arrow([" ".join(words)])
        own = column.nbytes
        assert rows_of(tokens.encode(column)) == [plain(" ".join(words))]
        taken = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before - own
    finally:
        tracemalloc.stop()
    assert taken < 100 * len(words)


@pytest.mark.parametrize("limit, each", [(500_000, 64), (40, 64), (500_000, 0.001)])
def test_pieces_of_slices_numbered_together(monkeypatch, limit, each):
    """Also with empty slices, slices of odd texts alone, and pieces forgotten by their number or by their bytes."""
    monkeypatch.setattr(token_files, "REMEMBERED", limit)
    monkeypatch.setattr(token_files, "REMEMBERED_BYTES", each)
    tokens = token_files.Tokens(PLAIN_PATH)
    for seed in range(6):
        texts = [random_texts(40 + seed, 60), [], [None, "", "a  b"], [prose(seed, 200) + " x" * 50], TEXTS + MORE]
        for column, found in zip(texts, tokens.encode_slices([arrow(t) for t in texts]), strict=True):
            assert rows_of(found) == [plain(t) for t in column]
        assert len(tokens.ids) == tokens.stops[-1] and len(tokens.known) == len(tokens.used) == len(tokens.stops) - 1
    if (limit, each) != (500_000, 64):
        tokens.encode(arrow([""]))  # has no pieces
        assert len(tokens.known) <= limit / 2
        assert sum(len(p.encode()) for p in tokens.known.to_pylist()) + 4 * len(tokens.ids) <= limit * each / 2


def test_an_error_while_learning_leaves_what_was_remembered(monkeypatch):
    tokens = token_files.Tokens(PLAIN_PATH)
    tokens.encode(arrow(["some words 1a"]))
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(tokens, "_library", lambda text: (_ for _ in ()).throw(RuntimeError("lost")))
        tokens.encode(arrow(["other words 2b"]))
    texts = ["1a other some", "2b words"]
    assert rows_of(tokens.encode(arrow(texts))) == [plain(t) for t in texts]


def test_pieces_of_any_script_equal_the_library():
    tokens, signs = token_files.Tokens(PLAIN_PATH), [chr(c) for c in [*range(1, 0x3100), *range(0xA000, 0xAC10), *range(0xF900, 0x10400, 3)]]
    texts = [f"a{c}b {c}{c} x{c}. {c}" for c in signs]
    for text, got in zip(texts, rows_of(tokens.encode(arrow(texts)))):
        assert got == plain(text), text


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 2000, 300_000])
def test_token_file_round_trip(tmp_path, n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 60_000, n).astype(np.uint32)
    ids[: n // 3] = rng.integers(5, 9, n // 3)
    ids[::97] = 4_000_000_000  # exceptions
    out = io.BytesIO()
    writer = token_files.Writer(out)
    third = n // 3
    writer.add([7, None], [third, 0], ids[:third])
    writer.add([9], [n - third], ids[third:])
    writer.close()
    path = tmp_path / "t.pfor"
    path.write_bytes(out.getvalue())
    reader = token_files.Reader(str(path))
    docs = list(reader.documents())
    assert [(d, a, len(x)) for d, a, x in docs] == [(7, 0, third), (None, third, 0), (9, third, n - third)]
    assert np.array_equal(np.concatenate([x for *_, x in docs]), ids)
    for a, b in ((0, 5), (n // 2, n // 2 + 700), (n - 3, n + 9)):
        assert np.array_equal(reader.read(max(0, a), b), ids[max(0, a) : b])
    path.write_bytes(out.getvalue()[:-3])
    with pytest.raises(ValueError):
        token_files.Reader(str(path))


def test_token_files_of_documents(odd_docs, no_docs):
    rows = sorted(token_files.round_trip(odd_docs).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in rows]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    at = 0
    texts = {}
    for r in odd_docs.collect():
        texts.setdefault(r.doc_id, []).append(zlib.crc32(np.array([*plain(r.text), 2], "<u4").tobytes()))
    for r in rows:
        assert r.start == at and r.ids_crc32 in texts[r.doc_id]
        at += r.n_tokens
    assert token_files.round_trip(no_docs).count() == 0

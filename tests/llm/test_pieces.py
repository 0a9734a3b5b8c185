import os
import random

import numpy as np
import pytest

from strata.llm.pieces import (MODEL, Lattice, boundary_vectors, combine, decode, encode, join_paths,
                               load_vocabulary)
from tests.llm.conftest import EDGE, make, prose

pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="no vocabulary file here")


@pytest.fixture(scope="module")
def vocabulary():
    return load_vocabulary()


@pytest.fixture(scope="module")
def lattice(vocabulary):
    return Lattice(vocabulary)


def ids(data):
    return np.frombuffer(data, np.int32).tolist()


def brute(lattice, text):
    """Best path over the whole text, node by node."""
    if not text:
        return []
    text = " " + text
    best, back = [0], [0]
    for end in range(1, len(text) + 1):
        options = [(best[s] + lattice.score[text[s:end]], -s) for s in range(max(0, end - lattice.span), end)
                   if text[s:end] in lattice.score]
        if text[end - 1] not in lattice.score:
            options.append((best[end - 1] + lattice.unknown, 1 - end))
        score, start = max(options)  # ties: the longest last piece
        best.append(score)
        back.append(-start)
    cuts = [len(text)]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    cuts = cuts[::-1]
    out = []
    for a, b in zip(cuts, cuts[1:]):
        piece = text[a:b]
        out += [lattice.ids[piece]] if piece in lattice.ids else [lattice.byte_id[x] for x in piece.encode()]
    return out


def texts():
    rng = random.Random(8)
    return [t for _, t in EDGE if t and len(t) < 5000] + [
        "a" * 300, "  " * 60, "x" * 90 + " " * 30 + "日本語テスト" * 20, "the of and " * 20, "▁ ▁a", "é\x00\n\t b", " lead",
        "trail ", "supercalifragilistic" * 20] + [
        "".join(rng.choice("ab c  deé\n日t") for _ in range(rng.randint(1, 300))) for _ in range(60)]


def chunked(lattice, text, size):
    text = " " + text
    parts = [(text[max(0, at - lattice.span + 1):at + size], min(at, lattice.span - 1)) for at in range(0, len(text), size)]
    vectors = boundary_vectors([lattice.transfer(p, n) for p, n in parts], lattice.span)
    paths = [lattice.paths(p, n, v.tolist()) for (p, n), v in zip(parts, vectors)]
    return ids(join_paths([p[0] for p in paths], [p[1] for p in paths], [p[2] for p in paths], lattice.span))


def test_encoding_is_the_best_path(lattice):
    for text in texts():
        assert ids(lattice.encode(text)) == brute(lattice, text), text[:40]


def test_decoding_gives_the_text_back(lattice):
    for text in texts():
        assert lattice.decode(ids(lattice.encode(text))) == text


@pytest.mark.parametrize("size", [16, 17, 40, 123])
def test_chunks_give_the_same_ids(lattice, size):
    for text in texts():
        assert chunked(lattice, text, size) == ids(lattice.encode(text)), (size, text[:40])


def test_products_of_matrices_are_associative(lattice):
    text = " " + "ab cd" * 40 + "日本" * 30
    parts = [(text[max(0, at - lattice.span + 1):at + 37], min(at, lattice.span - 1)) for at in range(0, len(text), 37)]
    m = [lattice.transfer(p, n) for p, n in parts][:4]
    assert (combine(combine(m[0], m[1]), combine(m[2], m[3])) == combine(m[0], combine(m[1], combine(m[2], m[3])))).all()


def test_best_score_equals_the_library(lattice, vocabulary):
    """The public library's n-best search over the same pieces, as a unigram model."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor()
    library.LoadFromSerializedProto(model.SerializeToString())
    total = lambda x: sum(vocabulary[i][1] for i in x)
    for word in set(" ".join(t for _, t in EDGE if t and t.isascii() and len(t) < 3000).split()):
        if len(word) < 30:
            best = library.nbest_encode_as_ids(word, 2)[0]
            assert total(best) == total(ids(lattice.encode(word))), word


def test_rows_and_chunks_in_spark(spark, lattice, vocabulary):
    rows = [*EDGE, (40, " ".join(prose(k, 300) for k in range(9))), (40, "日本語" * 2000), (None, "y" * 3000)]
    docs = make(spark, rows).repartition(4)
    out = encode(docs, vocabulary, carry=("text", "lang", "_id", "run"), chunk_chars=1000)
    assert out.columns == ["doc_id", "text", "lang", "_id", "run", "ids"]
    got = sorted(((r["doc_id"], r["text"], r["ids"]) for r in out.collect()), key=str)
    assert got == sorted([(i, t, ids(lattice.encode(t or ""))) for i, t in rows], key=str)
    back = decode(out, vocabulary, text_col="again")
    assert back.where("again <> coalesce(text, '')").count() == 0 and back.count() == len(rows)


def test_scan_of_many_blocks(spark, lattice, vocabulary, monkeypatch):
    from strata.llm import pieces

    monkeypatch.setattr(pieces, "SCANNED", 3)
    rows = [(1, "日本 テスト" * 300), (2, prose(5, 700)), (3, "z" * 400), (4, "short")]
    out = encode(make(spark, rows), vocabulary, chunk_chars=50, decoded="again").collect()
    assert sorted((r["doc_id"], r["ids"], r["again"]) for r in out) == [(i, ids(lattice.encode(t)), t) for i, t in rows]


def test_fractional_scores_of_a_unigram_model():
    """Best paths by floating-point scores, where rounding to whole numbers would choose others."""
    rng = random.Random(3)
    bytes_ = [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    model = [("▁", -0.6, 1), ("a", -1.3, 1), ("b", -1.3, 1), ("▁ab", -3.4, 1)] + bytes_
    fixed = Lattice(model)
    assert [model[i][0] for i in ids(fixed.encode("ab"))] == ["▁", "a", "b"]
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(60)} | set("abc"))
    model = [(w, rng.uniform(-9, -0.1), 1) for w in words] + [("▁" + w, rng.uniform(-9, -0.1), 1) for w in words[::2]]
    model += [("▁", -0.7, 1)] + bytes_
    fixed, score = Lattice(model), {p.replace("▁", " "): s for p, s, kind in model if kind == 1}
    for _ in range(40):
        text = " " + "".join(rng.choice("aabbc ") for _ in range(rng.randint(1, 60)))
        best = [0.0]
        for end in range(1, len(text) + 1):
            best.append(max(best[s] + score[text[s:end]] for s in range(max(0, end - 6), end) if text[s:end] in score))
        found = ids(fixed.encode(text[1:]))
        assert b"".join(fixed.bytes_of[i] for i in found).decode() == text
        assert sum(model[i][1] for i in found) == pytest.approx(best[-1], abs=1e-3)


def test_empty_table_and_arguments(no_docs, vocabulary):
    assert encode(no_docs, vocabulary).count() == 0
    assert decode(encode(no_docs, vocabulary), vocabulary).count() == 0
    with pytest.raises(ValueError):
        encode(no_docs, vocabulary, chunk_chars=5)
    with pytest.raises(ValueError):
        Lattice([("a", 0.0, 1)])


def test_the_query_returns_the_ids(spark, vocabulary):
    from strata.llm.queries import op3_sentencepiece

    sf = os.environ.get("STRATA_TEST_SF", "/root/testdata/sf0.001")
    if not os.path.isdir(sf):
        pytest.skip("no driver tables here")
    rows = op3_sentencepiece(spark, sf).collect()
    assert rows and all(len(r["ids"]) == r["n_tokens"] and r["round_trip"] for r in rows)

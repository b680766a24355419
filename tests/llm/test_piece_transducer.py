import pickle
import random

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb
from rows import corpus, table

from lendlens.llm import piece_transducer as p


@pytest.fixture(scope="module")
def model():
    return p.compile_model()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=p.MODEL_PATH)


def test_same_pieces_as_the_library(model, library):
    rng = random.Random(1)
    pieces = list(model.arcs)
    endings = ["", "  ", "\n", "日本", "ﷺ", "é\x00", " ▁", "ааа", "aaaa", "      x", "🙂"]
    for _ in range(5000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 5))) + rng.choice(endings)
        assert model.encode(text) == library.encode(text)
        assert model.decode(model.encode(text)) == text.replace(p.MARK, " ")


def test_documents(spark, library):
    found = p.encode_documents(table(spark, extra=True))
    rows = found.collect()
    assert len(rows) == len(corpus()) and all(r.round_trip and r.n_tokens == len(r.token_ids) for r in rows)
    assert sorted(map(repr, ((r.doc_id, r.token_ids) for r in rows))) == sorted(
        map(repr, ((i, library.encode(text or "")) for i, text, *_ in corpus()))
    )
    texts = {r.doc_id: r.text for r in p.decode_documents(found).collect()}
    assert all(texts[i] == (text or "").replace(p.MARK, " ") for i, text, *_ in corpus())
    assert p.encode_documents(table(spark, [])).count() == 0


def test_unigram_model_takes_the_least_sum():
    scores = {" ": -4.0, "a": -3.0, "b": -3.0, "ab": -4.0, " a": -3.5, "bab": -5.0}
    model = p.Transducer({x: i for i, x in enumerate(scores)}, scores, list(range(100, 356)), 99, False)

    def best(text):
        if not text:
            return 0.0, []
        ways = [(c - scores[x], [i, *rest]) for i, x in enumerate(scores) if text.startswith(x) for c, rest in [best(text[len(x) :])]]
        return min(ways)

    for text in ("ab", "bab", "abab", "babab", "aab", "a b", "ab bab"):
        ids = model.encode(text)
        assert sum(-scores[list(scores)[i]] for i in ids) == pytest.approx(best(" " + text)[0])
    assert model.encode("é") == [0, 100 + 0xC3, 100 + 0xA9]


def handmade(tmp_path, spec, kind, byte_fallback, pieces):
    """A model file with the given pieces, and the library's reading of it."""
    proto = pb.ModelProto()
    proto.normalizer_spec.CopyFrom(spec)
    proto.trainer_spec.model_type, proto.trainer_spec.byte_fallback = kind, byte_fallback
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    rows += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256) if byte_fallback]
    for piece, score, type_ in rows + [(x, score, 1) for x, score in pieces.items()]:
        proto.pieces.add(piece=piece, score=score, type=type_)
    path = tmp_path / "handmade.model"
    path.write_bytes(proto.SerializeToString())
    return p.compile_model(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))


#: Pieces of a handmade model; the longer ones come of merges too.
PIECES = ["▁", "a", "b", "c", "f", "i", "ア", "é", "ab", "fi", "▁a", "▁b", "bab", "cab", "abc", "▁ab", "fia", "▁fi", "▁▁"]
ALPHABET = ["a", "b", "c", "f", "i", "ﬁ", "Ａ", "ａ", "ｂ", "ｱ", "é", "e\u0301", " ", "  ", "\u3000", "\t", "\x01", "▁", "日", "x", "①", "가", "\u0301", "\n"]


@pytest.mark.parametrize("rule", ["identity", "nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("kind", [1, 2])
@pytest.mark.parametrize("byte_fallback", [True, False])
@pytest.mark.parametrize("squeeze", [True, False])
def test_normalisers_of_other_models(tmp_path, rule, kind, byte_fallback, squeeze):
    spec = pb.NormalizerSpec()
    spec.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec())
    spec.remove_extra_whitespaces, spec.add_dummy_prefix, spec.escape_whitespaces = squeeze, True, True
    # Sums of these are exact in single precision too, and rarely equal.
    scores = {x: -(2 + (i * 37 % 64) / 16 + len(x) / 2) if kind == 1 else float(-i) for i, x in enumerate(PIECES)}
    model, library = handmade(tmp_path, spec, kind, byte_fallback, scores)
    rng = random.Random(3)
    for _ in range(1500):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 9)))
        assert model.encode(text) == library.encode(text), ascii(text)
        if byte_fallback and "\u2581" not in text:
            assert model.decode(model.encode(text)) == library.decode(library.encode(text)), ascii(text)


def test_models_that_are_refused(tmp_path):
    spec = pb.NormalizerSpec(add_dummy_prefix=False, escape_whitespaces=True, remove_extra_whitespaces=False)
    with pytest.raises(ValueError, match="in front"):
        handmade(tmp_path, spec, 1, True, {"▁": -1.0})
    spec.add_dummy_prefix = True
    with pytest.raises(ValueError, match="behind another"):
        handmade(tmp_path, spec, 1, True, {"a▁": -1.0})


def test_text_longer_than_a_batch(spark, library, monkeypatch):
    monkeypatch.setattr(p, "BATCH_BYTES", 1 << 10)
    long = "the quick brown fox  日本 " * 2000
    docs = spark.createDataFrame([(1, "short"), (2, long), (None, long), (2, long), (3, None)], "doc_id long, text string")
    rows = p.encode_documents(docs.withColumns({"token_ids": docs.text, "n_tokens": docs.text})).collect()
    assert sorted((repr(r.doc_id), r.n_tokens, r.round_trip) for r in rows) == sorted(
        (repr(r.doc_id), len(library.encode(r.text or "")), True) for r in docs.collect()
    )
    assert all(r.token_ids == library.encode(long) for r in rows if r.doc_id in (2, None))


def test_neighbours_by_merging(model, library):
    rng = random.Random(2)
    plain = [i for i, x in model.pieces.items() if " " not in x]
    for _ in range(3000):
        a, b = rng.choice(plain), rng.choice(plain)
        left, right = model.pieces[a], model.pieces[b]
        merged = [i for i in model._path(left + right)]
        assert model.neighbours(a, b) == (merged == [a, b])


def test_a_sent_model_remembers_paths_as_bytes_and_starts_without_any():
    model = p.compile_model()
    text = "some words, some words and \U0001f9ee odd-ones"
    ids = model.encode(text)
    assert model.encode(text) == ids and all(isinstance(path, bytes) for path in model._known.values())
    sent = pickle.loads(pickle.dumps(model))
    assert not sent._known and sent.encode(text) == ids

import numpy as np
import pytest
from plain import DOCS, awkward, prose, with_clashes

from boreline.llm.chunks import default_path
from boreline.llm.piece_file import fields
from boreline.llm.piece_viterbi import MARK, PieceCoder, decode_ids, encode_texts

PATH = default_path("piece_bpe_32k.model")
TEXTS = [t or "" for _, t, *_ in awkward()] + ["a  b", "  x ", f"日本語 {MARK} a", "\n\n a\t", " ", MARK, "naïve 梦 END", "  \n  \n", "hello-world's 12345", "    y"]


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The same file with its type set to unigram."""
    data = bytearray(open(PATH, "rb").read())
    spec = next(v for n, v in fields(bytes(data)) if n == 2)
    at = data.find(spec) + spec.find(b"\x18\x02")
    data[at + 1] = 1
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(data)
    return str(path)


def test_ids_are_the_library_s(spark):
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    own = PieceCoder(PATH)
    for t in TEXTS + [prose(s, 200) for s in range(20)]:
        assert np.frombuffer(own.encode(t), "<i4").tolist() == library.encode(t), t[:80]
        assert own.decode(np.frombuffer(own.encode(t), "<i4")) == t.replace(MARK, " ")
    rows = awkward()
    got = encode_texts(with_clashes(spark.createDataFrame(rows, DOCS)))
    found = sorted(((r.doc_id, list(r.ids), r.n_pieces, r.round_trip) for r in got.collect()), key=str)
    assert found == sorted(((i, e := library.encode(t or ""), len(e), True) for i, t, *_ in rows), key=str)
    texts = sorted(((r.doc_id, r.text) for r in decode_ids(got).collect()), key=str)
    assert texts == sorted(((i, t or "") for i, t, *_ in rows), key=str)
    assert encode_texts(spark.createDataFrame([], DOCS)).count() == 0


def test_best_scores_are_found(unigram):
    import sentencepiece
    library, own = sentencepiece.SentencePieceProcessor(model_file=unigram), PieceCoder(unigram)
    table = {own.names[i]: own.scores[i] for i in own.names}

    def best(s):
        scores = [0.0] + [None] * len(s)
        for end in range(1, len(s) + 1):
            found = [scores[a] + table[s[a:end]] for a in range(max(0, end - 16), end) if s[a:end] in table]
            scores[end] = max(found + ([] if s[end - 1] in table else [scores[end - 1] + own.unknown_score]))
        return scores[-1]

    for t in ["the", "ouen the of", "international", "with rethething", "xqzj", "naïve", "a\nb", prose(3, 6)]:
        s = MARK + t.replace(" ", MARK)
        ids, score = own.segment(s)
        assert score == pytest.approx(best(s), rel=1e-12)
        if "\n" not in t:
            assert sum(own.scores[i] for i in ids) == pytest.approx(score) or own.unknown_score <= -1e9
    for t in ("the", "with", "other", "rest in"):
        assert [library.id_to_piece(i) for i in own.segment(MARK + t.replace(" ", MARK))[0]] == library.nbest_encode_as_pieces(t, 2)[0]

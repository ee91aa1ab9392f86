import os
import random
from itertools import product

import pytest

from wardstone.llm import pieces
from wardstone.llm.pieces import MODEL, Pieces, decode, digests, encode

sentencepiece = pytest.importorskip("sentencepiece")
needs = pytest.mark.skipif(not os.path.exists(MODEL), reason="no vocabulary file")


@needs
def test_ids_are_those_of_the_library(spark, frame, edge, prose):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(3)
    alphabet = "abcdeéß 12\n\t.,▁😀中 theTHE-_"
    rows = edge + [(100 + i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80)))) for i in range(300)] + [(500, " lead"), (501, "  two  "), (502, "▁")]
    out = decode(encode(frame(rows, clash=True))).select("doc_id", "text", "ids", "decoded").collect()
    assert len(out) == len(rows)
    for r in out:
        assert list(r.ids) == lib.encode(r.text or ""), r.text
        assert r.decoded == (r.text or "").replace("▁", " ")
    assert all(r.exact for r in digests(frame(rows)).collect())
    assert digests(frame([])).count() == 0 and encode(frame([])).count() == 0


def test_unigram_is_the_best_segmentation():
    rng = random.Random(4)
    vocabulary = ["<unk>", "▁", "a", "b", "c", "▁a", "ab", "bc", "abc", "▁ab", "ca", "cab"]
    scores = [0.0, -3.0, -2.5, -2.6, -2.7, -3.5, -3.1, -3.3, -4.0, -4.2, -3.9, -4.4]
    p = Pieces(vocabulary, scores, [2] + [1] * 11, bpe=False)

    def best(word):
        found = (float("-inf"), None)
        for cuts in product([0, 1], repeat=len(word) - 1):
            parts, at = [], 0
            for i, c in enumerate([*cuts, 1], 1):
                if c:
                    parts.append(word[at:i])
                    at = i
            if all(x in vocabulary for x in parts):
                found = max(found, (sum(scores[vocabulary.index(x)] for x in parts), parts))
        return found[0]

    words = list({"▁" + "".join(rng.choice("abc") for _ in range(rng.randint(0, 8))) for _ in range(150)})
    got = p.forward(words)
    for w in words:
        assert abs(sum(scores[i] for i in got[w]) - best(w)) < 1e-9 and "".join(vocabulary[i] for i in got[w]) == w
    assert p.forward(["▁aXb"])["▁aXb"] == (5, 0, 3)


@needs
def test_caches_are_bounded_and_shared():
    p = Pieces.load()
    p.most = 50
    a = [p.encode_batch([f"word{i} another{i}" for i in range(40)])[0].tolist() for _ in range(2)]
    assert a[0] == a[1] and len(p.moves) + p.tried <= 4 * 50 + 1000
    import pickle

    assert pickle.loads(pickle.dumps(p)) is pickle.loads(pickle.dumps(p)) and pieces._held(p) is p

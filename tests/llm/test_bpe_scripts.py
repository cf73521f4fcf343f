"""Unsplit text of many scripts is cut into parts, and joined to the ids of the whole."""

import random

import numpy as np
import pytest

from revlytics.llm import bpe

SCRIPTS = {
    "latin": "abcdefghijklmnop", "capitals": "ABCDEFGH", "accents": "éàüßñöçîÀÉ", "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюяЖ", "greek": "αβγδεζηθικλμνξοπρστυφχψωςΣ", "hangul": "가나다라마바사아자차카타파하한글", "kana": "あいうえおかきくけこアイウエオ",
    "ideographs": "漢字文章一二三四五六七八", "arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "hebrew": "אבגדהוזחטיכלמנסעפצקרשת", "emoji": "🙂🚀🎉🔥🐍📦", "signs": "*_#=.~+-/", "digits": "0123456789", "thai": "กขคงจฉชซฌญฎฏฐณดตถทธนบปผฝพฟภมยรลวศษสหฬอฮะาำเแโใไ",
}


@pytest.mark.parametrize("name", SCRIPTS)
def test_unsplit_text_has_parts(name):
    rng, own = random.Random(name), bpe.encoder(bpe.vocabulary_path())
    for size in (6000, 6001):
        text = "".join(rng.choices(SCRIPTS[name], k=size))
        raw = text.encode()
        parts = bpe.cut_parts(raw, 1500)
        assert len(parts) > 2 and b"".join(p for p, _ in parts) == raw, name
        level = [(own.encode([p])[0], glued) for p, glued in parts]
        while len(level) > 1:
            pairs = [level[i : i + 2] for i in range(0, len(level), 2)]
            level = [((own.glue(p[0][0], p[1][0]) if p[1][1] else p[0][0] + p[1][0]), p[0][1]) if len(p) == 2 else p[0] for p in pairs]
        want = own.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(level[0][0], np.uint32).tolist() == want, name


def test_mixed_text(spark):
    rng = random.Random(1)
    alphabet = "".join(SCRIPTS.values()) + " \n.,'é́<|" * 2
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(1, 2500))) for _ in range(60)] + ["<|endoftext|>" * 90, "a" * 900 + "'s" * 200, "", None]
    own = bpe.encoder(bpe.vocabulary_path())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: np.frombuffer(r["ids"], np.uint32).tolist() for r in bpe.encode_texts(df, bpe.vocabulary_path(), part_bytes=400).collect()}
    assert got == {i: own.tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}


def test_odd_words_are_those_of_the_tokenizer():
    own = bpe.encoder(bpe.vocabulary_path())
    odd = ["", " ", " x y\u0085z", "a\x1cb\x1fc", "​q", "x. y", "A<|endoftext|>B c.", "<|EndOfText|>", "don't I'll 's 'S", "..", "a..", "3.", "é.", "É,", "ａ.", "ǅ", "ﬁ.", "İ.", "ß", "x́.", "a,b,c,", "﻿a", "9,.", "z.,", "à b", "  a", "…à …", "\tA\n\x0bB\x0c\rC", "क़.", "İİ!!", "a1?!", "'.", "a'.", "é$$$", "$$$", "É", "ÀB", "x<.", "9%", "ſ.", "ŉ,"]
    odd += ["".join(random.Random(i).choices("ab.,9é  \n\t'<|>Źà…\u0085​  ", k=40)) for i in range(1500)]
    for i in range(0, len(odd), 100):
        got = own.encode([x.encode() for x in odd[i : i + 100]])
        assert [np.frombuffer(g, np.uint32).tolist() for g in got] == [e.ids for e in own.tokenizer.encode_batch_fast(odd[i : i + 100], add_special_tokens=False)]
    assert own.encode([]) == []

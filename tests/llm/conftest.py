import re
import unicodedata

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, uid string, component int, rate string, copies string, shard string, slot string, "
    "row_number string, key string, lang_ok string, toxic string, quality_ok string, lm_bits string, __row string, __v string, __copy string, __id string, part string, `a b` string, h string, g string, r string, y string, value string, maybe string"
)
LONG = " ".join(f"word{i % 997}" for i in range(60_000))


def word_spans(text):
    """(start, end, token) character by character: runs of word characters, but single ones in scripts without spaces."""
    out, run = [], None
    for i, c in enumerate(text + " "):
        word = re.match(r"\w", c)
        alone = word and unicodedata.name(c, "").startswith(("CJK", "HIRAGANA", "KATAKANA", "THAI", "LAO", "MYANMAR", "KHMER"))
        if run is not None and (not word or alone):
            out.append((run, i, text[run:i].lower()))
            run = None
        if alone:
            out.append((i, i + 1, c.lower()))
        elif word and run is None:
            run = i
    return out


def tokens(text):
    return [t for _, _, t in word_spans(text or "")]


def documents():
    """Nulls everywhere, empty, blank, very long and repeated texts, repeated rows, ids with two texts, clashing columns."""
    extra = ("x",) * 2
    prose = "the quick brown fox jumps over the lazy dog while seven wizards quietly bake bread in the old stone tower near the river"
    rows = [
        (1, prose, "en", "a"), (1, prose, "en", "a"), (2, prose, "en", "a"), (3, prose.upper() + "!", "en", "b"), (4, "", "en", "a"), (5, None, "en", "a"), (6, "   \n\t ", None, None), (7, LONG, "en", "b"),
        (8, LONG + " end", "en", "b"), (None, prose, "en", "a"), (None, None, None, None), (9, "short", "de", "a"), (10, "short", "de", None), (9, "another text under the same number", "en", "b"),
        (11, "日本語のテキスト", None, "c"), (12, "😀 🙂 !!! ###", "en", "c"), (13, "der die das und ist nicht ein eine mit auf für von dem den", "de", "c"), (14, "İstanbul İİ\x00 zero", "en", "c"),
    ]
    return [(i, None if t is None else t.encode("utf-8", "replace").decode(), lang, s, None if t is None else len(t), *extra[:1], 7, *("clash",) * 22) for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def nasty(spark):
    return spark.createDataFrame(documents(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)

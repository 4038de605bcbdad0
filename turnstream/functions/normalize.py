"""Text normalisation for alignment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnstream.functions.scalars import nfkc, without_accents

# What the normaliser treats as punctuation (signs, quotes, other scripts, then the punctuation list in its order).
PUNCTUATION = (
    ".?,:!{}"
    "\u201c\u201d\u00ab\u00bb\u2039\u203a\u201e\u201a\u201f\u201b\u2019\u2018"
    ">< \u00bf\u3002;"
    "\u055a\u055b\u055c\u055d\u055e\u055f\u0589"
    "\u00a1\u060c\u3001\u0964\"\u061b\u061f"
    "\u3002\uff0c\uff01\uff1f\uff1b\uff1a\uff08\uff09\u300c\u300d\u300e\u300f\uff41\uff42\uff43\uff44\u3008\u3009\u300a\u300b\ufe4f\u22ef\u3001\u2027\uff0f\uff5e\u2500\uff3f"
    "\x81\x90\x08\x8d\x94\x8f\x1a\x9d\x93\x92"
    "\ue295\uf21d\uf62d\uf173\ue514\ue293\uf523\ue233\uf50f\ue232\uea7b\uf172\ue290\uf519\ue292\ue328\ue2fa\ue234\ue043\ue040\ue2fb\ue32b\ue236\uf511"
    "\ue517\ue2fe\ue492\uf52d\ue2fc\uf521\ue516\ue041\uf529\ue2f9\ue2d9\ue32a\ue291\ue296\ue518\ue32c\ue2db\ue231\uf522\uf518\uf513\ue32d\ue32e\ue06b"
    "\uea01\ue294\ue203\uf218\ue070\ue013\ue2de\ue493\uf7e8\uf7d0\ue313\ue329\ue06d\ue003\uf50e\uf171\ue01d"
    "\u206f\u2060―־)]⌋〕】﴾&།።፥༌။/၊·‸*۔፤၏។꓾᙮꤯⵰꓿॥؞\u06da\u06d6\u06d7၍\u0387†၌፣៖꤮※፦•¶၎﹖\u037e…%・༎‡#@፡៚៕﹐༅༄．﹗﹕‰･"
    "([⌊〔【﴿_$€£~=|−≫≪+＜＞¬×→᙭°႟\ufffd⌟⌞©\u202f\u2006˜^¯ˇⁿๆៗ々ໆーⁱ৷⅓½¼⅟⁄"
)
#: one line of the punctuation list has no tab, so that all of its signs count
SWALLOWED = "7355 ARABIC SMALL HIGH LIGATURE QAF WITH LAM WITH ALEF MAKSURA"
DELETED = "\u200e\u200c\u0656\u0657\u200b\u064b\u064c\u064d\u064e\u064f\u0650\u0651\u0652\u202c\u200f\u202a"
WRITTEN_OUT = ["&lt;", "&gt;", "&nbsp"]
QUOTES = "\u201b\u2019\u2018"
#: single characters and what they become, in any language
ARABIC = {"\u0671": "\u0627", "\u0670": "\u0627", "\u06e5": "\u0648", "\u06e6": "\u064a", "\u0640": "", "\u0653": "", "\u0654": "\u0621", "\u0655": "\u0621"}
DIGITS = "0-9০-৯០-៩०-९୦-୯۰-۹꤀-꤉０-９൦-൯၀-၉ⅰ-ⅹ\u206f"
#: what languages add to the deletions and to the punctuation, and those whose accents go
MORE_DELETED = {"mon": "\u00ad", "khk": "\u00ad", "heb": "".join(map(chr, range(0x05B0, 0x05D0)))}
MORE_PUNCTUATION = {"tha": "\u200d"}
WITHOUT_ACCENTS = ["jav"]
CHARACTER_LANGUAGES = ["jpn", "chi"]


def characters(language: str = "*", swallowed: bool = True) -> tuple[str, str]:
    """What ``translate`` needs: characters, and at the same places what they become; the rest goes.

    An earlier rule goes before a later one: mapped characters, punctuation to spaces, deletions.
    """
    mapped = {k: v for k, v in ARABIC.items() if v}
    spaces = PUNCTUATION + MORE_PUNCTUATION.get(language, "") + (SWALLOWED if swallowed else "")
    gone = "".join(k for k, v in ARABIC.items() if not v) + DELETED + MORE_DELETED.get(language, "")
    return "".join(mapped) + spaces + gone, "".join(mapped.values()) + " " * len(spaces)


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _translated(text: Column, language: str | Column, swallowed: bool) -> Column:
    """Characters by the rules of a language; of each row's own one, if that is a column."""
    if isinstance(language, str):
        return F.translate(text, *characters(language, swallowed))
    out = F.translate(text, *characters("*", swallowed))
    for own in sorted({*MORE_DELETED, *MORE_PUNCTUATION}):
        out = F.when(language == own, F.translate(text, *characters(own, swallowed))).otherwise(out)
    return out


def text_normalize(text: Column, language: str | Column = "*", lower: bool = True, numbers: bool = True, brackets: bool = False, swallowed: bool = True) -> Column:
    """Compatibility form, lower case, bracketed text with digits away, mappings, punctuation to spaces, deletions, digit words away.

    Words of digits only go if white space parts them from others; digits within words stay, but for those
    that the punctuation list itself holds (``swallowed``). Of the curly apostrophes within a word the last
    one becomes a straight one. Languages without rules of their own take those of "*", as do rows without a language where
    it is a column; Arabic's mappings hold for all. Each step reads a text once.
    """
    text = nfkc(text)
    if lower:
        text = F.lower(text)
    open_ = text.contains("(")
    text = F.when(open_, F.regexp_replace(text, r"\([^)]*\p{Nd}[^)]*\)", " ")).otherwise(text)
    if brackets:
        text = F.regexp_replace(text, r"\([^)]*\)", " ")
    for old in WRITTEN_OUT:
        text = F.replace(text, F.lit(old), F.lit(""))
    # the last quote of a word that has characters on both sides: behind it no other quote but at the word's end
    quote = rf"(?U)(?<=\S)[{QUOTES}](?=[^\s{QUOTES}]++[{QUOTES}]?+(?!\S)|[{QUOTES}](?!\S))"
    text = F.regexp_replace(text, quote, "'")
    text = _translated(text, language, swallowed)
    if numbers:
        d = f"[{DIGITS}]+"
        text = F.regexp_replace(text, rf"(?U)^{d}(?=\s)|(?<=\s){d}(?=\s)|(?<=\s){d}$", " ")
    if not isinstance(language, str):
        text = F.when(language.isin(WITHOUT_ACCENTS), without_accents(text)).otherwise(text)
    elif language in WITHOUT_ACCENTS:
        text = without_accents(text)
    return squeezed(text)


def split_text(text: Column, size: str = "word") -> Column:
    """Words, single characters, or sentences (up to a full stop, exclamation or question mark before white space)."""
    if size == "word":
        return words_of(text)
    if size == "char":
        return F.filter(F.split(text, ""), lambda c: c != "")
    if size == "sentence":
        return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: x != "")
    raise ValueError("split size must be sentence, word or char")


def preprocess_text(df, text: str, keep: list[str], language: str = "eng", size: str = "word", frequency: str = "segment", romanize: bool = False):
    """keep, tokens, texts: the parts of each text as spread letters, and as they are, with stars put in.

    Japanese and Chinese are split into characters. Parts are normalised one by one, so they are rows of
    their own until they are gathered again in order.
    """
    if frequency not in ("segment", "edges"):
        raise ValueError("star frequency must be segment or edges")
    parts = split_text(F.col(text), "char" if language in CHARACTER_LANGUAGES else size)
    each = df.select(*keep, F.posexplode_outer(parts).alias("part_no", "part"))
    normal = text_normalize(F.trim(F.coalesce("part", F.lit(""))), language)
    token = latin_only(spread(normal)) if romanize else spread(normal)
    gathered = each.withColumn("token", token).groupBy(*keep).agg(F.array_sort(F.collect_list(F.when(F.col("part_no").isNotNull(), F.struct("part_no", "token", "part")))).alias("all_parts"))
    tokens, texts = F.transform("all_parts", lambda x: x["token"]), F.transform("all_parts", lambda x: x["part"])
    return gathered.select(*keep, starred(tokens, frequency).alias("tokens"), starred(texts, frequency).alias("texts"))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def latin_only(text: Column) -> Column:
    """Lower case, all but letters a-z, apostrophes and spaces to spaces, squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z' ]", " "), " +", " "))


def spread(word: Column) -> Column:
    """Characters with spaces between."""
    return F.array_join(F.filter(F.split(word, ""), lambda c: c != ""), " ")


def uroman_tokens(words: Column) -> Column:
    """Each word as its spread Latin letters; words that have none give an empty token.

    Accents should be off already (``without_accents``); other scripts need a library that is not here.
    """
    return F.transform(words, lambda w: latin_only(spread(w)))


def starred(tokens: Column, frequency: str = "segment") -> Column:
    """A star before each token, or one at each edge."""
    star = F.lit("<star>")
    if frequency == "segment":
        return F.flatten(F.transform(tokens, lambda t: F.array(star, t)))
    if frequency == "edges":
        return F.concat(F.array(star), tokens, F.array(star))
    raise ValueError("star frequency must be segment or edges")

"""Text checks on completions as native column expressions.

Every function takes and returns a ``Column``; nothing leaves the JVM.
A null text gives null, not 0.

Regex parity notes (checked against Python ``re`` on random tag strings):
  * a "word" is a maximal run of Unicode letters, digits and ``_`` — Java's
    plain ``\\w`` is ASCII-only, so the class is spelt out;
  * case-insensitive tag matching uses ``(?iu)`` (Unicode case folding, as
    Python does for ``str`` patterns);
  * ``strip`` removes Unicode whitespace at both ends — ``trim`` only
    removes spaces;
  * positions are derived from ``length`` of split pieces, so they count
    code points like Python does, not UTF-16 units.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (must equal the scoring rules) --------------------------
# The 20 residue letters accepted in a designed sequence, upper case only.
RESIDUES = "ARNDCEQGHILKMFPSTWYV"
# Tag names recognised by the format checks.
TAG_NAMES = ("think", "answer")
# Word-count limit, think-tag limit and minimum think text length.
MAX_WORDS = 200
MAX_THINKS = 3
MIN_THINK_CHARS = 10
# ---------------------------------------------------------------------------

WORD = r"[\p{L}\p{N}_]++"  # possessive: same matches, less backtracking
WS = r"[\t\n\x{0B}\f\r\x{1C}-\x{1F}\x{85}\p{Z}]"
# Case variants that Unicode case-insensitive matching accepts for the tag
# letters (Kelvin sign for k, long s for s, dotless/dotted i for i).  Spelling
# them out keeps the patterns case-sensitive, which Java matches much faster
# than with the (?iu) flag, and matches the same strings.
_VARIANTS = {"i": "iI\u0131\u0130", "k": "kK\u212A", "s": "sS\u017F"}


def _ci(word: str) -> str:
    return "".join(f"[{_VARIANTS.get(ch, ch + ch.upper())}]" for ch in word)


_TAGS = "|".join(TAG_NAMES)
_TAGS_CI = "|".join(_ci(t) for t in TAG_NAMES)
TAG_ANY_CI = rf"</?(?:{_TAGS_CI})>"
OPEN_ANY_CI = rf"<(?:{_TAGS_CI})>"
THINK_OPEN_CI = rf"<{_ci('think')}>"
THINK_CLOSE_CI = rf"</{_ci('think')}>"
ANSWER_OPEN_CI = rf"<{_ci('answer')}>"
THINK_BLOCK_CI = rf"(?s){THINK_OPEN_CI}(.*?){THINK_CLOSE_CI}"
ANSWER_BLOCK_CI = rf"(?s){ANSWER_OPEN_CI}(.*?)</{_ci('answer')}>"
ANSWER_BLOCK_CS = r"(?s)<answer>(.*?)</answer>"
BLOCK_CS = rf"(?s)<({_TAGS})>(.*?)</\1>"
BLOCK_CI = rf"{THINK_BLOCK_CI}|<{_ci('answer')}>.*?</{_ci('answer')}>"
TAG_CS = rf"</?(?:{_TAGS})>"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    """Python ``str.strip()``: Unicode whitespace removed at both ends."""
    return F.regexp_replace(_c(x), rf"\A{WS}+|{WS}+\z", "")


def word_count(x) -> Column:
    """Number of ``\\b\\w+\\b`` words (Unicode word characters)."""
    return F.regexp_count(_c(x), F.lit(WORD))


def count_matches(x, pattern: str) -> Column:
    return F.regexp_count(_c(x), F.lit(pattern))


def think_blocks(x) -> Column:
    """Inner texts of every ``<think>…</think>`` block (i, s)."""
    return F.regexp_extract_all(_c(x), F.lit(THINK_BLOCK_CI), 1)


def answer_blocks(x) -> Column:
    """Inner texts of every ``<answer>…</answer>`` block (i, s)."""
    return F.regexp_extract_all(_c(x), F.lit(ANSWER_BLOCK_CI), 1)


def think_text(x) -> Column:
    """all think blocks joined by one space."""
    return F.array_join(think_blocks(x), " ")


def has_think(x) -> Column:
    """F4."""
    return _c(x).rlike(THINK_OPEN_CI).cast("int")


def has_any_tag(x) -> Column:
    """F5."""
    return _c(x).rlike(OPEN_ANY_CI).cast("int")


def tagged_ratio(x) -> Column:
    """words inside case-sensitive matched blocks / words of the text
    with (case-sensitive) tags deleted; 0 when there are no words."""
    t = _c(x)
    total = word_count(F.regexp_replace(t, TAG_CS, ""))
    inner = F.regexp_extract_all(t, F.lit(BLOCK_CS), 2)
    tagged = word_count(F.array_join(inner, " "))
    return F.when(total > 0, tagged / total).otherwise(F.when(t.isNotNull(), F.lit(0.0)))


def not_too_long(x, max_words: int = MAX_WORDS) -> Column:
    """F7."""
    return (word_count(x) <= max_words).cast("int")


def one_answer(x) -> Column:
    """F8."""
    return (count_matches(x, ANSWER_OPEN_CI) == 1).cast("int")


def answer_after_thinks(x) -> Column:
    """start of the first ``<answer>`` strictly after the end of the
    last ``</think>``; 0 if either is absent (adjacent tags give 0)."""
    t = _c(x)
    by_answer = F.split(t, ANSWER_OPEN_CI, 2)
    by_think = F.split(t, THINK_CLOSE_CI, -1)
    answer_start = F.length(F.get(by_answer, 0))
    think_end = F.length(t) - F.length(F.element_at(by_think, -1))
    present = (F.size(by_answer) > 1) & (F.size(by_think) > 1)
    return F.when(t.isNull(), None).otherwise(
        F.when(present & (answer_start > think_end), 1).otherwise(0))


def thinks_have_text(x, min_chars: int = MIN_THINK_CHARS) -> Column:
    """F10."""
    return (F.length(strip(think_text(x))) > min_chars).cast("int")


def no_nested_tags(x) -> Column:
    """no (i, s) block whose inner text holds any tag.

    A whole block holds its own two tags, so "nested" is more than two.
    """
    blocks = F.regexp_extract_all(_c(x), F.lit(BLOCK_CI), 0)
    return (~F.exists(blocks, lambda b: F.regexp_count(b, F.lit(TAG_ANY_CI)) > 2)).cast("int")


def limited_thinks(x, max_thinks: int = MAX_THINKS) -> Column:
    """F12."""
    return (count_matches(x, THINK_OPEN_CI) <= max_thinks).cast("int")


def tags_closed(x) -> Column:
    """stack over open/close tags found case-insensitively, names
    compared as written (``<Think></think>`` fails); no tags gives 1."""
    return tags_closed_from(F.regexp_extract_all(_c(x), F.lit(TAG_ANY_CI), 0))


def all_tags(x) -> Column:
    """Every open/close tag in order (case-insensitive), as written."""
    return F.regexp_extract_all(_c(x), F.lit(TAG_ANY_CI), 0)


def tag_count(tags: Column, pattern: str) -> Column:
    """How many of the extracted ``tags`` are exactly ``pattern``.

    Every occurrence of a tag in the text is itself one of the extracted
    tags (a tag holds ``<`` only at its start, so matches cannot overlap),
    so this equals counting ``pattern`` over the whole text.
    """
    return F.size(F.filter(tags, lambda g: g.rlike(rf"\A{pattern}\z")))


def tags_closed_from(tags: Column) -> Column:
    """F1 over an already extracted tag array (see :func:`all_tags`)."""
    empty = F.array().cast("array<string>")

    def step(st, g):
        is_close = g.startswith("</")
        close_name = F.substring(g, F.lit(3), F.length(g) - 3)
        open_name = F.substring(g, F.lit(2), F.length(g) - 2)
        top = F.get(st, F.size(st) - 1)
        popped = F.when(top == close_name, F.slice(st, F.lit(1), F.size(st) - 1))
        return (F.when(st.isNull(), F.lit(None).cast("array<string>"))
                .when(is_close, popped)
                .otherwise(F.concat(st, F.array(open_name))))

    folded = F.aggregate(tags, empty, step)
    return F.when(tags.isNull(), None).otherwise(
        F.coalesce(F.size(folded) == 0, F.lit(False)).cast("int"))


def ends_with_answer(x) -> Column:
    """F2 (case-sensitive, after strip)."""
    return strip(x).endswith("</answer>").cast("int")


def starts_with_think(x) -> Column:
    """F3 (case-sensitive, after strip)."""
    return strip(x).startswith("<think>").cast("int")


def binary_answer(x, blocks: Column | None = None) -> Column:
    """tri-state yes/no from the first answer block, else the whole text.

    First block: contains "yes" → true, else contains "no" → false.  If the
    block has neither (or there is none): whole text with exactly one of
    "yes"/"no"; both or neither → null.  ``blocks``: the answer blocks, where
    they are already a column.
    """
    t = _c(x)
    first = F.lower(F.get(answer_blocks(t) if blocks is None else blocks, 0))
    whole = F.lower(t)
    has_yes = F.contains(whole, F.lit("yes"))
    has_no = F.contains(whole, F.lit("no"))
    fallback = (F.when(has_yes & ~has_no, F.lit(True))
                .when(has_no & ~has_yes, F.lit(False)))
    return (F.when(F.contains(first, F.lit("yes")), F.lit(True))
            .when(F.contains(first, F.lit("no")), F.lit(False))
            .otherwise(fallback))


def designed_sequence(x, block: Column | None = None) -> Column:
    """F16: struct(seq, valid) from the first answer block.

    Block stripped and every character a residue → (text, true); otherwise
    (null, false); no block → (null, null).  An empty block is valid.
    ``block``: the stripped first block, where it is already a column.
    """
    if block is None:
        block = strip(F.get(answer_blocks(x), 0))
    valid = block.rlike(rf"\A[{RESIDUES}]*\z")
    return F.struct(F.when(valid, block).alias("seq"), valid.alias("valid"))


def keyword_list(k) -> Column:
    """Non-empty ``|``-separated parts; a null string counts as empty."""
    return F.filter(F.split(F.coalesce(_c(k), F.lit("")), r"\|"), lambda s: s != "")


def keyword_mention(x, keywords, design_mode: bool = False, think: Column | None = None) -> Column:
    """F17 (answer mode) / F18 (design mode: exactly one found → 1.0).

    No keywords → 1.0; empty think text → 0.0; otherwise the share of
    keywords contained (case-sensitive) in the think text.  ``think``: that
    text, where it is already a column.
    """
    kw = keyword_list(keywords)
    if think is None:
        think = think_text(x)
    found = F.size(F.filter(kw, lambda k: F.contains(think, k)))
    share = found / F.size(kw)
    if design_mode:
        share = F.when(found == 1, F.lit(1.0)).otherwise(share)
    return (F.when(_c(x).isNull(), None)
            .when(F.size(kw) == 0, F.lit(1.0))
            .when(think == "", F.lit(0.0))
            .otherwise(share))


def answer_confidence(x, classes, confidences, answer: Column | None = None) -> Column:
    """confidence of the class equal to the extracted answer.

    Classes are stripped and lower-cased; the first match wins; a match past
    the end of the confidences list (zip truncation) or no answer → 0.0.
    ``answer``: the extracted answer, where it is already a column.
    """
    ans = binary_answer(x) if answer is None else answer
    word = F.when(ans, F.lit("yes")).when(~ans, F.lit("no"))
    cls = F.transform(F.split(_c(classes), r"\|"), lambda c: F.lower(strip(c)))
    conf = F.split(_c(confidences), r"\|")
    idx = F.array_position(cls, word)
    value = F.get(conf, (idx - 1).cast("int")).cast("double")
    return F.when(_c(x).isNull(), None).otherwise(
        F.coalesce(F.when(idx > 0, value), F.lit(0.0)))


def first_keyword(k) -> Column:
    """The first non-empty keyword (the reference sequence), or null."""
    return F.get(keyword_list(k), 0)

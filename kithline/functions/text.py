"""Native column functions over names and addresses. All take and give SQL expressions as text."""

from __future__ import annotations

from kithline.functions.constants import ABBREVIATIONS, BLOCKING_SUFFIXES, FOLDED_ADDRESS_STOP, INDIC_LETTERS, LATIN_LETTERS, LEGAL_SUFFIXES

EMPTY = "cast(array() as array<string>)"
_PUNCT = r"[!-/:-@\\[-`{-~]"
_SPACE = r"[\\s\\p{Z}]+"


def quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def words(text: str) -> str:
    """Words of a text after ASCII marks count as blanks."""
    return f"filter(split(regexp_replace({text}, '{_PUNCT}', ' '), '{_SPACE}'), w -> w <> '')"


def without_legal_suffixes(name: str) -> str:
    """A normalised name without the legal suffixes at its end; a word always stays."""
    return f"regexp_replace({name}, '^(.+?)(?: (?:{'|'.join(LEGAL_SUFFIXES)}))+$', '$1')"


def core_tokens(name_cf: str) -> str:
    """ASCII words of four characters or more of a case-folded name, suffix words at its end left out (all may go)."""
    joined = f"concat(' ', array_join({words(name_cf)}, ' '))"
    return f"filter(split(regexp_replace({joined}, '(?: (?:{'|'.join(BLOCKING_SUFFIXES)}))+$', ''), ' '), w -> length(w) >= 4 and w rlike '^[\\\\x00-\\\\x7F]+$')"


def rough_tokens(name_cf: str) -> str:
    """ASCII words of two characters or more."""
    return f"filter({words(name_cf)}, w -> length(w) >= 2 and w rlike '^[\\\\x00-\\\\x7F]+$')"


def numbers(address: str) -> str:
    """Words of digits without leading zeros, zeros left out, in order. Digits are Unicode's decimal ones."""
    return f"filter(transform(filter({words(address)}, w -> w rlike '^\\\\p{{Nd}}+$'), w -> ltrim('0', w)), w -> w <> '')"


def latin_skeleton(tokens: str) -> str:
    """Joined tokens without vowels and h; c as k, x as ks; digits stay."""
    return f"replace(translate(array_join({tokens}, ''), 'caeiouh', 'k'), 'x', 'ks')"


def consonant_skeleton(folded: str) -> str:
    """Latin consonants of an accent-folded text, Indic letters as Latin ones; Latin h goes, Indic h stays."""
    latin = LATIN_LETTERS.replace("c", "k")
    return f"regexp_replace(translate(replace(regexp_replace({folded}, '[aeiouh]', ''), 'x', 'ks'), 'c{INDIC_LETTERS}', 'k{latin}'), '[^a-z]', '')"


def address_words(folded: str) -> str:
    """All words of a folded address, abbreviations written out."""
    pairs = ", ".join(f"'{a}', '{b}'" for a, b in ABBREVIATIONS.items())
    return f"transform(regexp_extract_all({folded}, '([\\\\p{{L}}\\\\p{{N}}]+)', 1), w -> coalesce(element_at(map({pairs}), w), w))"


def address_numbers(all_words: str) -> str:
    return f"array_distinct(transform(filter({all_words}, w -> w rlike '^\\\\p{{Nd}}+$'), w -> if(ltrim('0', w) = '', '0', ltrim('0', w))))"


def address_content(all_words: str) -> str:
    return f"array_distinct(filter({all_words}, w -> length(w) >= 4 and not w rlike '^\\\\p{{Nd}}+$' and w not in ({quoted(FOLDED_ADDRESS_STOP)})))"


def compact(text: str) -> str:
    """The letters and digits."""
    return f"regexp_replace({text}, '[^\\\\p{{L}}\\\\p{{N}}]', '')"


def grams(text: str, size: int = 3) -> str:
    """Distinct character grams of the letters and digits; a shorter text is one gram, an empty one none."""
    own = compact(text)
    return f"if({own} = '', {EMPTY}, array_distinct(transform(sequence(1, greatest(1, length({own}) - {size - 1})), i -> substring({own}, i, {size}))))"


def jaccard(a: str, b: str, both_empty: str = "0.0D") -> str:
    return f"if(size({a}) + size({b}) = 0, {both_empty}, size(array_intersect({a}, {b})) / cast(size(array_union({a}, {b})) as double))"


def dice(a: str, b: str) -> str:
    return f"if(size({a}) + size({b}) = 0, 0.0D, 2 * size(array_intersect({a}, {b})) / cast(size({a}) + size({b}) as double))"


def simhash(tokens: str) -> str:
    """64-bit sign sums over token hashes; a bit is set from a sum of 0 on, so no tokens give all ones."""
    votes = f"aggregate({tokens}, array_repeat(0, 64), (s, t) -> transform(s, (v, i) -> v + if((shiftrightunsigned(xxhash64(t), i) & 1L) = 1L, 1, -1)))"
    return f"aggregate({votes}, named_struct('bits', 0L, 'i', 0), (a, v) -> named_struct('bits', a.bits | if(v >= 0, shiftleft(1L, a.i), 0L), 'i', a.i + 1), a -> a.bits)"


def hamming(a: str, b: str) -> str:
    return f"bit_count({a} ^ {b})"


def match_bucket(count: str) -> str:
    return f"if({count} >= 8, '8+', cast({count} as string))"


def id_list(text: str) -> str:
    """Distinct ids of a comma list, blanks left out."""
    return f"array_distinct(filter(transform(split(coalesce({text}, ''), ','), x -> trim(x)), x -> x <> ''))"


def id_order(entity_id: str) -> str:
    """Orders ids by source, then number; not the identity."""
    return f"shiftleft(if({entity_id} like 'S2-%', 0L, 1L), 40) | try_cast(substring_index({entity_id}, '-', -1) as bigint)"


def f05(tp: str, predicted: str, true: str) -> str:
    return f"if({predicted} + {true} = 0, 1.0D, 1.25D * {tp} / ({predicted} + 0.25D * {true}))"

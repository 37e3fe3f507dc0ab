"""Scalar text functions as Column builders: nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: character classes of the corpus' orthography -------------------------------------------------
def char_class(ranges: str, java: bool = True) -> str:
    """The body of a regular expression's class from code points in hexadecimal, for Java or for Python."""
    parts = [r.split("-") for r in ranges.split()]
    return "".join("-".join(f"\\x{{{x}}}" if java else f"\\u{x}" for x in r) for r in parts)


MARKS = "0610-061A 064B-065F 0670 06D6-06DC 06DF-06E8 06EA-06ED"
LETTERS = "0621-063A 0640-064A 066E-06D3 06D5 06E5 06E6 06EE 06EF 06FA-06FF"
#: Marks that name search drops, the accents of decomposed Latin among them.
NAME_MARKS = "0610-061A 064B-065F 0670 06D6-06ED"
DIACRITICS = f"[{char_class(MARKS)}]"
TATWEEL = char_class("0640")
AR_LETTERS = char_class(LETTERS)
#: White space as the corpus' producers mean it, with NBSP and the byte order mark.
SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
LETTER_FOLDS = ("آأإٱىةؤئ", "اااايهوي")

# ---- fixed values: stop words of the text index -----------------------------------------------------------------
ARABIC_STOP_WORDS = """من عن على في الي ان انه انها ما لا له لهم به بها هو هي هذا هذه ذلك التي الذي الذين كان كانت قال قالت قد ثم او اذا
الا حتي كل بن ابن الله حدثنا حدثني اخبرنا اخبرني سمعت رسول النبي صلي عليه وسلم رضي عنه عنها ولا وان وما وهو وهي وفي ومن وعن وقال
وقد فقال فلا فان وكان ليس وليس""".split()
ENGLISH_STOP_WORDS = """the a an and or of to in on at by for from with that this these those is was were are be been has have had it its
he she they them his her their we us our you your i me my as so if then than but not no said says narrated allah messenger prophet
reported""".split()

# ---- fixed values: honorific formulae ---------------------------------------------------------------------------
HONORIFICS = [
    r"\s*صلى\s*الله\s*عليه\s*و\s*(?:آله\s*و\s*)?سلم\s*",
    r"\s*صلعم\s*",
    r"\s*رض[يى]\s*الله\s*(?:تعالى\s*)?عنه[مان]*\s*",
    r"\s*عليه[ما]*\s*السلام\s*",
    r"\s*رحمه\s*الله\s*",
    r"\s*عز\s*و\s*جل\s*",
    r"\s*تبارك\s*و\s*تعالى\s*",
    f"[{char_class('0610-0614 FDFA FDFB 06DD')}]",
]

# ---- fixed values: readings of a critic's wording, most severe first ---------------------------------------------
ARABIC_GRADES = [
    ("fabricator", "كذاب|وضاع|يضع الحديث|متهم بالكذب|دجال"),
    ("abandoned", "متروك|ذاهب الحديث|ليس بثقة|ليس بشيء|هالك"),
    ("unknown", "مجهول|لا يعرف|لا يُعرف|مستور"),
    ("weak", "ضعيف|لين|سيء الحفظ|ليس بالقوي|واه|منكر الحديث"),
    ("mostly_reliable", "صدوق|لا بأس به|ليس به بأس|مقبول|صالح الحديث"),
    ("reliable", "ثقة|ثقه|ثبت|حافظ|متقن|حجة|وثقوه|وثق|إمام"),
]

# ---- fixed values: classes of transmitters and how the sources word them -------------------------------------------
CLASS_ORDINALS = {"الاولى": 1, "الثانيه": 2, "الثالثه": 3, "الرابعه": 4, "الخامسه": 5, "السادسه": 6, "السابعه": 7, "الثامنه": 8, "التاسعه": 9, "العاشره": 10, "الحاديه عشره": 11, "الثانيه عشره": 12}
COMPANION_WORDS = ["صحابي", "صحابية", "له صحبة", "لها صحبة", "من الصحابة", "الصحابة"]
DISPUTED_COMPANION = ["مختلف في صحبته", "مختلف في صحبتها", "يقال له صحبة"]

# ---- fixed values: number words -----------------------------------------------------------------------------------
UNITS = {"احدي": 1, "واحده": 1, "اثنتين": 2, "ثلاث": 3, "اربع": 4, "خمس": 5, "ست": 6, "سبع": 7, "ثمان": 8, "تسع": 9, "عشر": 10, "عشره": 10}
TENS = {"عشرين": 20, "ثلاثين": 30, "اربعين": 40, "خمسين": 50, "ستين": 60, "سبعين": 70, "ثمانين": 80, "تسعين": 90}
HUNDREDS = {"ماىه": 100, "مايه": 100, "مايتين": 200, "ماىتين": 200, "ثلاثماىه": 300, "ثلاثمايه": 300}

# ---- fixed values: titles before a name ---------------------------------------------------------------------------
TITLES = ["امير المومنين", "ام المومنين", "الامام", "الحافظ", "الشيخ", "سيدنا", "مولانا"]

# ---- fixed values: letters as transliterations write them -----------------------------------------------------------
ROMAN_DIGRAPHS = {"ث": "th", "خ": "kh", "ذ": "dh", "ش": "sh", "غ": "gh"}
ROMAN_LETTERS = {"ا": "a", "ب": "b", "ت": "t", "ج": "j", "ح": "h", "د": "d", "ر": "r", "ز": "z", "س": "s", "ص": "s", "ض": "d", "ط": "t", "ظ": "z", "ف": "f", "ق": "q", "ك": "k", "ل": "l", "م": "m", "ن": "n", "ه": "h", "و": "w", "ي": "y"}


def key_of(text: str) -> str:
    """Python twin of normalise_key, for literals only."""
    import re

    text = re.sub(f"[{char_class(MARKS + ' 0640', False)}]", "", text).translate(str.maketrans(*LETTER_FOLDS))
    return " ".join(re.sub(f"[^{char_class(LETTERS, False)}\\s]", " ", text).split())


def _words(values) -> Column:
    return F.array(*map(F.lit, values))


def squeeze(c: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def strip_diacritics(c: Column) -> Column:
    return F.regexp_replace(c, f"{DIACRITICS}|{TATWEEL}", "")


def fold_letters(c: Column) -> Column:
    return F.translate(c, *LETTER_FOLDS)


def normalise_arabic(c: Column) -> Column:
    return fold_letters(strip_diacritics(c))


def normalise_key(c: Column) -> Column:
    """The lookup key of a name: folded letters, everything that is not an Arabic letter a space."""
    return F.trim(F.regexp_replace(F.regexp_replace(normalise_arabic(c), f"[^{AR_LETTERS}]", " "), " +", " "))


def strip_honorifics(c: Column) -> Column:
    for formula in HONORIFICS:
        c = F.regexp_replace(c, formula, " ")
    return squeeze(c)


def strip_editorial(c: Column) -> Column:
    c = F.regexp_replace(c, "؛", "،")
    c = F.regexp_replace(c, "[«»\"'‘’“”()\\[\\]{}﴿﴾]", " ")
    return squeeze(F.regexp_replace(c, r"\s*[-–—ـ]\s*", " "))


def parse_death_year(c: Column) -> Column:
    """The first number of a note as a year from 1 to 1500, else null."""
    ascii_ = F.translate(c, "٠١٢٣٤٥٦٧٨٩", "0123456789")
    n = F.floor(F.nullif(F.regexp_extract(ascii_, r"(\d{1,4}(?:\.\d+)?)", 1), F.lit("")).cast("double") + 0.5).cast("int")
    return F.when((n > 0) & (n <= 1500), n)


def normalise_grade(c: Column) -> Column:
    """One spelling for each ruling; null for what has no Latin letter."""
    g = squeeze(F.regexp_replace(F.regexp_replace(c, "[‘’ʻʼ`´]", "'"), "'{2,}", "'"))
    g = F.trim(F.regexp_replace(g, r"[,;]\s*$", ""))
    weak = F.regexp_replace(F.regexp_replace(g, r"\bD[aA]'?\s?[iI][fF]\b", "Da'if"), r"\bd[aA]'?\s?[iI][fF]\b", "da'if")
    return F.when(g.rlike("[A-Za-z]"), F.regexp_replace(weak, r"(?i)\bMa[wu]du'?", "Maudu'"))


def letters_only(c: Column) -> Column:
    return F.regexp_replace(strip_diacritics(c), f"[^{char_class('0621-064A')}]", "")


def strip_prefixes(w: Column) -> Column:
    """A fused one-letter particle, then the article, each only off a word of more than four letters."""
    w = F.when((F.length(w) > 4) & w.rlike("^[وفبكل]"), F.substring(w, 2, 1 << 20)).otherwise(w)
    return F.when((F.length(w) > 4) & w.startswith("ال"), F.substring(w, 3, 1 << 20)).otherwise(w)


def tokenise(c: Column) -> Column:
    """The index terms of a text, in order, with repeats."""
    words = F.filter(F.split(strip_diacritics(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w.rlike(r"\p{L}"))
    terms = F.transform(words, lambda w: F.when(w.rlike(f"[{char_class('0600-06FF')}]"), strip_prefixes(fold_letters(w))).otherwise(F.lower(w)))
    # The two lists share no word: each is written in its own script.
    return F.filter(terms, lambda w: (F.length(w) >= 3) & ~w.isin(ARABIC_STOP_WORDS + ENGLISH_STOP_WORDS))


def bigrams(terms: Column) -> Column:
    n = F.size(terms)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.zip_with(F.slice(terms, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(terms, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)))


def fold_name(c: Column) -> Column:
    """Case, accents, vowel signs, letter variants, apostrophes and punctuation away. Accents by one translation table."""
    import unicodedata

    pairs = {}
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(x for x in unicodedata.normalize("NFD", chr(cp).lower()) if not 0x300 <= ord(x) <= 0x36F)
        if len(base) == 1 and base != chr(cp):
            pairs[chr(cp)] = base
    c = F.translate(F.lower(c), "".join(pairs), "".join(pairs.values()))
    c = F.regexp_replace(c, f"[{char_class('0300-036F ' + NAME_MARKS)}]", "")
    c = F.translate(c, "أإآٱىئؤة", "ااااييوه")
    return squeeze(F.regexp_replace(c, r"[ʿʾʻʼ'’`´\-–—.,:;()]", ""))


def skeleton(folded: Column) -> Column:
    """The consonants that two spellings of a name share."""
    for letter, roman in ROMAN_DIGRAPHS.items():
        folded = F.replace(folded, F.lit(letter), F.lit(roman))
    s = F.regexp_replace(F.translate(folded, "".join(ROMAN_LETTERS), "".join(ROMAN_LETTERS.values())), "[^a-z]", "")
    s = F.regexp_replace(F.regexp_replace(s, "[aeiouwy]", ""), r"(.)\1+", "$1")
    return F.regexp_replace(s, "^l", "")


def grade_from_arabic(c: Column) -> Column:
    plain, out = strip_diacritics(c), F.lit(None).cast("string")
    for grade, pattern in reversed(ARABIC_GRADES):
        out = F.when(plain.rlike(pattern), grade).otherwise(out)
    return F.when(c != "", out)


def clean_value(c: Column) -> Column:
    """Trimmed; null for the ways in which sources write nothing."""
    t = F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")
    return F.when(~F.lower(t).isin("", "-", "nan", "null", "none"), t)


def parse_class(c: Column) -> Column:
    """The ordinal class that a note words; contested companionship is null, companionship 1, the longest ordinal wins."""
    key = normalise_key(c)
    out = F.lit(None).cast("int")
    for word, n in sorted(CLASS_ORDINALS.items(), key=lambda x: len(key_of(x[0]))):
        out = F.when(key.contains(key_of(word)), n).otherwise(out)
    any_of = lambda words: F.exists(_words(map(key_of, words)), lambda w: key.contains(w))
    return F.when(any_of(DISPUTED_COMPANION), None).when(any_of(COMPANION_WORDS), 1).otherwise(out)


def named_as_woman(full_name: Column, kunya: Column, note: Column, grade: Column) -> Column:
    """'daughter of' before any 'son of', a mother's kunya, or said outright."""

    def plain(c: Column) -> Column:
        return F.trim(F.translate(F.regexp_replace(F.coalesce(c, F.lit("")), f"[{char_class(NAME_MARKS)}]", ""), "آأإٱةى", "ااااهي"))

    words = F.split(plain(full_name), r"\s+")
    at = lambda w: F.array_position(words, w)
    sons = F.least(*[F.when(at(w) > 0, at(w)).otherwise(1 << 20) for w in ("بن", "ابن")])
    said = F.concat(plain(note), F.lit(" "), plain(grade)).rlike("ام المؤمنين|صحابيه")
    return ((at("بنت") > 0) & (at("بنت") < sons)) | plain(full_name).rlike(r"^ام\s") | plain(kunya).rlike(r"^ام\s") | said


def year_in_words(c: Column) -> Column:
    """A year written out; units overwrite, 'ten' directly behind a unit adds ten, an attached 'and' is taken off."""
    table = lambda d: F.create_map(*[F.lit(x) for k, v in d.items() for x in (k, v)])
    units, tens, hundreds = table(UNITS), table(TENS), table(HUNDREDS)
    start = F.struct(F.lit(0).alias("u"), F.lit(0).alias("t"), F.lit(0).alias("h"), F.lit(False).alias("seen"), F.lit(False).alias("unit"))

    def step(s: Column, raw: Column) -> Column:
        attached = (F.length(raw) > 2) & raw.startswith("و")
        w = F.when(attached, F.substring(raw, 2, 1 << 20)).otherwise(raw)
        teen = w.isin("عشر", "عشره") & s["unit"] & ~attached
        u, t, h = units[w], tens[w], hundreds[w]
        return F.struct(
            F.when(teen, s["u"] + 10).otherwise(F.coalesce(u, s["u"])).alias("u"),
            F.when(~teen & u.isNull() & t.isNotNull(), t).otherwise(s["t"]).alias("t"),
            F.when(~teen & u.isNull() & t.isNull() & h.isNotNull(), h).otherwise(s["h"]).alias("h"),
            (s["seen"] | (~teen & F.coalesce(u, t, h).isNotNull())).alias("seen"),
            (~teen & u.isNotNull()).alias("unit"),
        )

    end = F.aggregate(F.split(normalise_key(F.coalesce(c, F.lit(""))), " "), start, step)
    year = end["u"] + end["t"] + end["h"]
    return F.when(end["seen"] & (year > 0), year)


def same_year(entry: Column, held: Column) -> Column:
    return (F.abs(entry - held) <= 2) | ((entry < 100) & (F.abs(entry % 100 - held % 100) <= 2))


def years_in(c: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\d{1,3})"), 1)
    return F.filter(F.transform(found, lambda x: x.cast("int")), lambda n: n > 0)


def clean_entry(c: Column) -> Column:
    """An entry without the page marks of its printed edition."""
    return squeeze(F.regexp_replace(c, r"(?<![A-Za-z0-9_])(?:ms\d+|PageV\d+P\d+|Page\d+)(?![A-Za-z0-9_])", " "))


def head_of(c: Column, words: int = 12) -> Column:
    return F.slice(F.split(normalise_key(clean_entry(c)), " "), 1, words)


def class_in_entry(c: Column) -> Column:
    """The class that a biographical entry states: companionship in words, else the first ordinal just behind 'of the'."""
    key = normalise_key(c)
    companion = key.rlike(r"(?:^|\s)(?:صحاب[يى]ه?|له\s+صحبه?|مخضرم)(?=\s|$)")
    runs = F.regexp_extract_all(key, F.lit(r"(?:^|\s)من\s+((?:\S+\s+){0,3}\S+)(?=\s|$)"), 1)
    ordinals = F.transform(F.flatten(F.transform(runs, lambda r: F.split(r, " "))), parse_class)
    return F.when(companion, 1).otherwise(F.get(F.filter(ordinals, lambda n: n.isNotNull()), F.lit(0)))


def death_in_entry(c: Column) -> Column:
    phrase = F.regexp_extract(c, r"مات\s+سنة\s+([^\d]{0,40})", 1)
    return year_in_words(F.get(F.split(phrase, r"\s(?:وله|وهو\s+ابن|عن)\s"), F.lit(0)))


def display_name(surface: Column, full: Column) -> Column:
    n = lambda c: F.size(F.split(F.trim(c), r"\s+"))
    return F.when(F.coalesce(full, F.lit("")) == "", surface).when((n(full) < n(surface)) | (n(full) > 6), surface).otherwise(full)


def settled_name(c: Column) -> Column:
    """A name up to the first other reading that the sources add to it."""
    return F.trim(F.get(F.split(c, r"\s*[،,]?\s*(?:ويقال|وقيل|وقال|:)\s"), F.lit(0)))


def short_name(author: Column) -> Column:
    return F.element_at(F.split(F.trim(F.regexp_replace(author, r"\s*\(d\..*\)\s*$", "")), r"\s+"), -1)


def kunya_variants(key: Column) -> Column:
    """The key itself, its declined kunya form, and the key without an accusative alef: in lookup order."""
    rest = F.substring(key, 5, 1 << 20)
    declined = F.when(key.startswith("ابي ") | key.startswith("ابا "), F.concat(F.lit("ابو "), rest)).when(key.startswith("ابو "), F.concat(F.lit("ابي "), rest))
    bare = (F.length(key) > 3) & key.endswith("ا")
    return F.array_compact(F.array(key, declined, F.when(bare, F.regexp_replace(key, "ا$", ""))))


def strip_titles(words: Column) -> Column:
    out = words
    for title in reversed(TITLES):
        t = title.split(" ")
        out = F.when((F.size(words) > len(t)) & (F.slice(words, 1, len(t)) == _words(t)), F.slice(words, F.lit(len(t) + 1), F.size(words))).otherwise(out)
    return out


def spans(words: Column) -> Column:
    """All runs of words as (start from 0, len, run), the longest first, then from the left."""
    n = F.size(words)
    lengths = F.when(n > 0, F.sequence(n, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(lengths, lambda k: F.transform(F.sequence(F.lit(0), n - k), lambda s: F.struct(s.alias("start"), k.alias("len"), F.slice(words, s + 1, k).alias("run")))))


def rulings(grade: Column) -> Column:
    """The rulings that a grade words; denunciations stand alone, the others add up."""
    g = F.lower(grade)
    several = F.array_compact(F.array(F.when(g.rlike("da'if|daif|da if"), "daif"), F.when(g.contains("hasan"), "hasan"), F.when(g.contains("sahih"), "sahih")))
    return F.when(grade.isNull(), F.array().cast("array<string>")).when(g.rlike("maudu|mawdu"), _words(["mawdu"])).when(g.rlike("munkar|shadh"), _words(["munkar"])).otherwise(several)


def score_name(rank: Column, n: Column) -> Column:
    return F.log10(1 + n) - F.coalesce(F.get(F.array(*map(F.lit, (0.0, 0.3, 0.8, 1.0, 1.4, 2.0))), rank), F.lit(2.5))

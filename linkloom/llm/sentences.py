"""Sentence units of texts in many languages and scripts, in SQL expressions.

Marks that end no sentence (in decimals, addresses, initials, abbreviations, quotations and
brackets) are masked with private-use characters, one for one, so that positions stay those
of the text; regular expressions per script then place cuts after terminators.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.columns import computed_once

#: Marks that end sentences, what stands for them where they don't, and the cut.
ENDS = ".!?؟।。！？…"
MASK = "".join(chr(0xE200 + k) for k in range(len(ENDS)))
CUT = "\ue300"
DOT = MASK[0]
OPEN, CLOSE = "\ue301", "\ue302"
#: What stands for line ends within a quotation or brackets.
BREAKS, BREAK_MASK = "\n\r", "\ue303\ue304"
_RESERVED = MASK + CUT + OPEN + CLOSE + BREAK_MASK
#: The first two bytes of all of these.
RESERVED_LEADS = sorted({ch.encode()[:2] for ch in _RESERVED})

#: Abbreviations after which a sentence goes on.
ABBREVIATIONS = (
    "Prof|Dr|Mr|Mrs|Ms|Messrs|St|Adv|Hon|Rev|Gen|Col|Capt|Fig|fig|Figs|Art|art|para|paras|Sec|sec|approx|ca|Bros|Co|vs|est"
    "|al|cf|viz|Ph|Tab|Vol|vol|pp|Dept|Univ|vgl|Vgl|Abb|Abs|Nr|Mio|Mrd|bzw|usw|evtl|ggf|Hr|Str|Mme|Mlle|MM|suiv|env|av"
    "|Проф|проф|см|рис|ул|ст|стр|гл|тыс|руб|гг|им|др|пр|табл|डॉ|क्र|श्री|प्रो"
)
#: Abbreviations that may also end a sentence; they do if a capital follows.
SOFT_ABBREVIATIONS = "Ltd|Inc|Corp|LLC|Jr|Sr|hrs|hr|min|etc|нед|чел|мин|час"
#: Abbreviated months and numbers, which go on before a digit.
BEFORE_DIGITS = (
    "No|no|Nos|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec|янв|февр|апр|авг|сент|окт|нояб|дек|nº|Kap|Ziff|ch|т|с"
)
#: What follows an ordinal number written with a dot.
AFTER_ORDINALS = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Sitzung|Jahrhundert"
#: Thai function words (prepositions, conjunctions, final particles) before which a sentence goes on.
THAI_GOES_ON = "กับ|และ|หรือ|แต่|แล้ว|โดย|เป็น|ถึง|จาก|ที่|ของ|เพื่อ|เท่านั้น|ฯลฯ|ๆ|น\\."
#: Thai titles of persons; after those of the second list and a space one name follows.
THAI_LEADS = "ประธาน|ดร|นาย|นาง|นางสาว"
THAI_TITLES = f"(?:ดร|ศ)[.{DOT}] {{0,2}}|(?:นาย|นาง|นางสาว) {{1,2}}"

#: Fixed value: white space.
SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \u0085\u00a0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    chr(k) for k in range(0x2000, 0x200B)
)

_T = "[.!?؟।。！？]"
_CLOSERS = "[)\\]}\"'”’»›」』）]"
_WORD = "[\\p{L}\\p{M}\\p{N}]"
_BULLET = "[*•‣▪·◦–-]"



def _between(opener: str, closer: str, inside: str) -> str:
    """A region from opener to closer, of any length, without other marks of its kind and without a blank line."""
    return f"{opener}{inside}*+(?:\\r?\\n(?!\\s*[\\r\\n]){inside}*+)*+{closer}"


# the expressions begin with a test of one character, so that most positions are passed quickly; they don't backtrack
_QUOTED = "(?=[\"“„«「『(（])(?:" + "|".join(
    [
        # quotes between Hebrew letters belong to abbreviations
        f"\"(?<!{_WORD}\")[^\"\\n]*+(?:(?:(?<=[א-ת])\"(?=[א-ת])|\\n(?!\\s*\\n))[^\"\\n]*+)*+\"(?!{_WORD})",
        _between("“", "”", "[^“”\\r\\n]"),
        _between("„", "[“”]", "[^„“”\\r\\n]"),
        _between("«", "»", "[^«»\\r\\n]"),
        _between("「", "」", "[^「」\\r\\n]"),
        _between("『", "』", "[^『』\\r\\n]"),
        _between("\\(", "\\)", "[^()\\r\\n]"),
        _between("（", "）", "[^（）\\r\\n]"),
    ]
) + ")"


def _masked_regions(rows: DataFrame, name: str, text: Column) -> DataFrame:
    """rows with the text under a new name, what its quotations and brackets hold masked."""
    rows = computed_once(rows, "_marked", F.regexp_replace(text, _QUOTED, f"{OPEN}$0{CLOSE}"))
    # a blank line or an item of a list ends a unit even there
    inner = lambda p: F.when(p.rlike(f"[\\r\\n]\\s*(?:[\\r\\n]|{_BULLET}\\s)"), F.translate(p, ENDS, MASK)).otherwise(
        F.translate(p, ENDS + BREAKS, MASK + BREAK_MASK)
    )
    parts = F.split("_marked", f"[{OPEN}{CLOSE}]")
    plain = F.array_join(F.transform(parts, lambda p, k: F.when(k % 2 == 1, inner(p)).otherwise(p)), "")
    return computed_once(rows, name, F.when(F.contains("_marked", F.lit(OPEN)), plain).otherwise(F.col("_marked"))).drop("_marked")


#: Dots that end no sentence.
_DOTS = "\\.(?:" + "|".join(
    [
        "(?<=\\p{N}\\.)(?=\\p{N})",
        "(?=\\.)|(?<=\\.\\.)",
        "(?<=[a-z0-9]\\.)(?=[a-z0-9])",  # addresses
        "(?<=(?<![\\p{L}\\p{M}\\p{N}\"״'׳])\\p{L}\\p{M}?\\.)",
        f"(?<=(?<!{_WORD})(?:{ABBREVIATIONS}|{SOFT_ABBREVIATIONS})\\.)",
        f"(?<=(?<!{_WORD})(?:{BEFORE_DIGITS})\\.)(?=\\s*\\p{{N}})",
        f"(?<=\\p{{Nd}}\\.)(?=\\s+(?:{AFTER_ORDINALS}))",
        "(?<=(?:ดร|พ.ศ|ค.ศ)\\.)",
    ]
) + ")"

_OPENERS = "[\"“„«(]*"
_CAPITAL = f"(?=\\s+{_OPENERS}(?:[\\p{{Lu}}\\p{{Lo}}]|\\p{{Ll}}\\p{{Lu}})|\\p{{Lu}}\\p{{Ll}})"
_CUTS = f"(?=[.!?؟।。！？{DOT}])(?:" + "|".join(
    [
        # the space that should follow is missing
        f"{_T}+(?=[\"“„«]\\p{{L}})",
        "\\.(?=\\p{Lu}[\\p{Ll} ])(?<=[\\p{Ll}\\p{Nd})%»”]\\.)",
        "\\.(?=[א-ת])(?<=[א-ת][א-ת\"]\\.|[א-ת]\"[א-ת]\\.|[\\p{Nd})%]\\.)",
        "\\.(?=[\\u0621-\\u064a])(?<=[\\u0621-\\u064a]{2}\\.|[\\p{Nd})٪]\\.)",
        # terminators before white space, unless a small letter goes on
        f"{_T}+{_CLOSERS}*(?=\\s)(?!\\s+{_OPENERS}\\p{{Ll}}(?!\\p{{Lu}}))",
        f"{_T}*[!?؟।]{_T}*{_CLOSERS}*(?=[\\p{{Lu}}\\p{{Lo}}])",
        # scripts without spaces
        f"{_T}*[。！？]{_T}*{_CLOSERS}*(?!{_T}|{_CLOSERS})",
        # abbreviations that end a sentence
        f"{DOT}{_CAPITAL}(?<=(?:{SOFT_ABBREVIATIONS}|[ap]{DOT}m|\\p{{N}}{{4}} г|S{DOT}A){DOT})",
        f"{DOT}{{3,9}}{_CLOSERS}*(?=\\s+{_OPENERS}\\p{{Lu}})",
    ]
) + ")"
#: Thai puts a space between sentences, but also around the name after a title, between the items of a list that ends
#: with `and so on`, and after numbers unless they are years.
_THAI = (
    " (?=[\\u0e00-\\u0e7f])(?<=(?:[\\u0e00-\\u0e7f)%”\"]|(?:ปี|ศ.?) {0,2}\\p{Nd}{4}) {1,4})"
    f"(?!{THAI_GOES_ON})(?![^\\s]++ ฯลฯ)(?<!(?:{THAI_LEADS}) {{1,4}})(?<!(?:{THAI_TITLES})[^\\s]{{1,40}} )"
)

#: A line longer than this is no line of a broken paragraph, but a paragraph.
BROKEN_LINE = 130
_BLOCK = 16

_NL = "(?>\\r\\n|[\\r\\n])"
_IN_LINE = f"[^\\r\\n{BREAK_MASK}]"
_GOES_ON = "\\s*\\p{Ll}(?!\\p{Lu})"
#: A further line follows, not after a blank one.
_MORE = f"{_NL}(?!\\s*[\\r\\n])(?=\\s*\\S)"
_BLANK = "(?:\\r\\n|\\n|\\r)[^\\S\\n\\r]*(?:\\r\\n|\\n|\\r)\\s*"
#: Line ends that cut by themselves: at blank lines, after a long line, and before a line that is itself a
#: paragraph, as it is long or ends a sentence and is not the last.
_EACH = f"({_BLANK}|{_NL}(?!{_GOES_ON})(?:" + "|".join(
    [
        f"(?<={_IN_LINE}{{{BROKEN_LINE + 1}}}(?:\\r\\n|[\\r\\n]))",
        f"(?={_IN_LINE}{{{BROKEN_LINE + 1}}}{_IN_LINE}*[\\r\\n]\\s*\\S)",
        f"(?={_IN_LINE}*[.!?؟।。！？…{DOT}]{_CLOSERS}*[^\\S\\r\\n]*{_MORE})",
    ]
) + f")(?!{_IN_LINE}*{_NL}{_GOES_ON}))"


def _line_ends(masked: Column) -> Column:
    """Cuts at line ends: at all of them among labels, lists or paragraphs set off by blank lines, else at each by itself."""
    lines = F.split(masked, f"[\\r\\n{BREAK_MASK}]+")
    longest = F.array_max(F.transform(lines, lambda s: F.length(s)))
    structured = masked.rlike(f"(?m)^\\s*{_BULLET}\\s|[:：]\\s*$")
    paragraphs = masked.rlike(f"\\S\\s*?{_BLANK}\\S") & (longest > BROKEN_LINE)
    each = F.regexp_replace(masked, _EACH, f"$1{CUT}")
    every = F.regexp_replace(masked, f"((?:\\r\\n|\\n|\\r)+)(?!{_GOES_ON})", f"$1{CUT}")
    cut = F.when(structured | paragraphs, every).otherwise(each)
    return F.when(F.contains(masked, F.lit("\n")) | F.contains(masked, F.lit("\r")), cut).otherwise(masked)


def sentence_units(documents: DataFrame, id_column: str, text_column: str, with_text: bool = True) -> DataFrame:
    """(id_column, pos, start_char, end_char, sentence): the sentence units of each text in order.

    Positions count Unicode code points from 0, the end is exclusive; a unit carries its
    closing marks but no surrounding white space, and the units cover everything else. A title, a label
    and a line of a list are a unit each. Null, empty and blank texts have none. Texts may be
    of any length; repeated rows come out repeatedly, other columns are ignored. Without with_text there is
    no column sentence.
    """
    spaces = F.lit(SPACES)
    rows = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("_text")).where(
        F.length(F.ltrim("_text", spaces)) > 0
    )
    # characters that the masks use are ordinary ones if a text has them
    raw = F.col("_text").cast("binary")
    reserved = reduce(lambda a, lead: a | F.contains(raw, F.lit(lead)), RESERVED_LEADS[1:], F.contains(raw, F.lit(RESERVED_LEADS[0])))
    clean = F.when(reserved, F.translate("_text", _RESERVED, "x" * len(_RESERVED))).otherwise(F.col("_text"))
    rows = _masked_regions(rows, "_plain", clean)
    rows = computed_once(rows, "_masked", F.regexp_replace("_plain", _DOTS, DOT)).drop("_plain")
    rows = computed_once(rows, "_lined", _line_ends(F.col("_masked"))).drop("_masked")
    rows = computed_once(rows, "_cut", F.regexp_replace("_lined", _CUTS, f"$0{CUT}")).drop("_lined")
    thai = F.when(F.col("_cut").rlike("[\\u0e00-\\u0e7f]"), F.regexp_replace("_cut", _THAI, f"$0{CUT}"))
    rows = computed_once(rows, "_pieces", F.split(F.coalesce(thai, "_cut"), CUT)).drop("_cut")
    rows = computed_once(rows, "_n", F.transform("_pieces", lambda p: F.length(p).cast("long")))
    # where pieces begin: sums of whole blocks, then within the block
    blocks = F.sequence(F.lit(0), F.floor((F.size("_n") - 1) / _BLOCK).cast("int"))
    total = lambda list_: F.aggregate(list_, F.lit(0).cast("long"), lambda a, v: a + v)
    rows = computed_once(rows, "_sums", F.transform(blocks, lambda b: total(F.slice("_n", b * _BLOCK + 1, _BLOCK))))
    rows = computed_once(
        rows, "_begins", F.transform(F.col("_sums"), lambda s, b: total(F.slice("_sums", F.lit(1), b)))
    )

    def unit(piece: Column, k: Column) -> Column:
        block = F.floor(k / _BLOCK).cast("int")
        begin = F.get("_begins", block) + total(F.slice("_n", block * _BLOCK + 1, k % _BLOCK))
        lead = F.length(piece) - F.length(F.ltrim(piece, spaces))
        end = F.length(F.rtrim(piece, spaces))
        places = [(begin + lead).alias("start_char"), (begin + end).alias("end_char")]
        return F.struct(*places, F.btrim(piece, spaces).alias("sentence")) if with_text else F.struct(*places)

    units = F.filter(F.transform("_pieces", unit), lambda u: u["end_char"] > u["start_char"])
    found = rows.select("id", *(["_text", reserved.alias("_reserved")] if with_text else []), F.posexplode(units).alias("_k", "_unit"))
    start, end = F.col("_unit.start_char"), F.col("_unit.end_char")
    columns = [F.col("id").alias(id_column), (F.col("_k") + 1).cast("long").alias("pos"), start.alias("start_char"), end.alias("end_char")]
    if with_text:
        restored = F.translate("_unit.sentence", _RESERVED[: len(ENDS)] + BREAK_MASK, ENDS + BREAKS)
        as_written = F.substring("_text", (start + 1).cast("int"), (end - start).cast("int"))
        columns.append(F.when(F.col("_reserved"), as_written).otherwise(restored).alias("sentence"))
    return found.select(*columns)

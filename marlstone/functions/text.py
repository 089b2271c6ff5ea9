"""Column functions on text: lines, normalization, tokens, previews, markup, line patterns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Radical code points and the ideographs they stand for, in order.
RADICALS = "⻅⻉⻓⻚⻛⻜⼀⼆⼈⼊⼋⼏⼒⼗⼝⼤⼦⼩⼯⼰⼲⼼⼾⽀⽂⽅⽆⽇⽉⽌⽐⽔⽕⽚⽣⽤⽬⽰⽴⽹⽽⽿⾃⾄⾍⾏⾒⾔⾜⾥⾮⾯⾳⾼⿎"
IDEOGRAPHS = "见贝长页风飞一二人入八几力十口大子小工己干心戶支文方无日月止比水火片生用目示立网而耳自至虫行見言足里非面音高鼓"
# CJK punctuation that separates search terms.
SEPARATORS = "、。【】《》“”‘’—…·"
# Ranges of code points that count as CJK.
CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{2CEB0}-\x{2EBEF}\x{30000}-\x{3134F}"
# Tags that break a line.
BLOCK_TAGS = "article aside blockquote body br dd div dl dt footer h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table td th tr ul"
# Entities in the order in which they are decoded.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "))
PREVIEW = 160

FULL_WIDTH = "".join(map(chr, range(0xFF01, 0xFF5F)))
WIDTH_FROM = FULL_WIDTH + "\u3000" + RADICALS
WIDTH_TO = "".join(map(chr, range(0x21, 0x7F))) + " " + IDEOGRAPHS
#: How UTF-8 begins the characters from U+2E80 on; no other is CJK, a radical or of full width.
WIDE_STARTS = [bytes([0xE2, b]) for b in range(0xBA, 0xC0)] + [bytes([b]) for b in range(0xE3, 0xF5)]
SPACE = r"\p{IsWhite_Space}"
#: The characters of SPACE.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines(text: Column) -> Column:
    """The lines of a text: ends are LF or CRLF, and a final end starts no further line."""
    unix = F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"\n\z", "")
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(F.split(unix, "\n"))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def blank(text: Column) -> Column:
    return ~text.rlike(rf"[^{SPACE}]")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def collapse(text: Column) -> Column:
    return trim(F.regexp_replace(text, f"{SPACE}+", " "))


def preview(text: Column) -> Column:
    return F.substring(collapse(text), 1, PREVIEW)


def fold_width(text: Column) -> Column:
    """Full-width forms as ASCII, and radicals as ideographs."""
    return F.translate(text, WIDTH_FROM, WIDTH_TO)


def search_form(text: Column) -> Column:
    """The form in which texts and queries meet; capital sigma is lowered alike in every place."""
    mapped = F.translate(text, WIDTH_FROM + SEPARATORS + "\u03a3", WIDTH_TO + " " * len(SEPARATORS) + "\u03c3")
    return F.lower(F.when(is_ascii(text), text).otherwise(mapped))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def is_wide(text: Column) -> Column:
    """Whether a text has characters from U+2E80 on. Told by bytes: beside the search for tokens a second pattern costs more than that search."""
    held = text.cast("binary")
    return ~is_ascii(text) & reduce(Column.__or__, (F.contains(held, F.lit(start)) for start in WIDE_STARTS))


def holds(text: Column, word: str) -> Column:
    """Whether the search form of a text contains a word of ASCII letters and digits. Only wide characters become such, so that no other text needs the table."""
    return once(text, lambda t: F.lower(t).contains(word) | (is_wide(t) & search_form(t).contains(word)))


def tokens(text: Column) -> Column:
    """Runs of CJK or of word characters; a CJK run is followed by its 2-, 3- and 4-grams."""
    runs = F.regexp_extract_all(search_form(text), F.lit(rf"([{CJK}]+|[a-z0-9_[\p{{IsAlphabetic}}\p{{N}}&&[^{CJK}]]]+)"), F.lit(1))

    def grams(run: Column, n: int) -> Column:
        return F.when(F.length(run) >= n, F.transform(F.sequence(F.lit(1), F.length(run) - (n - 1)), lambda i: F.substring(run, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    def with_grams(run: Column) -> Column:
        return F.when(run.rlike(rf"\A[{CJK}]"), F.concat(F.array(run), grams(run, 2), grams(run, 3), grams(run, 4))).otherwise(F.array(run))

    # texts without wide characters need no table of them, and what search_form puts for separators parts words as they do
    simple = F.regexp_extract_all(F.lower(F.replace(text, F.lit("\u03a3"), F.lit("\u03c3"))), F.lit(r"[a-z0-9_\p{IsAlphabetic}\p{N}]+"), F.lit(0))
    return F.when(is_wide(text), F.flatten(F.transform(runs, with_grams))).otherwise(simple)


def token_estimate(text: Column) -> Column:
    """A quarter of each run of ASCII or white space, rounded up, and 1 for any other character; 1 at least."""
    cheap = rf"[\x00-\x7F{SPACE}]+"
    runs = F.aggregate(F.regexp_extract_all(text, F.lit(cheap), F.lit(0)), F.lit(0).cast("long"), lambda n, run: n + F.floor((F.length(run) + 3) / 4))
    mixed = F.greatest(F.lit(1).cast("long"), runs + F.length(F.regexp_replace(text, cheap, "")))
    return F.when(is_ascii(text), F.greatest(F.lit(1).cast("long"), F.floor((F.length(text) + 3) / 4))).otherwise(mixed)


def substring_count(text: Column, term: Column) -> Column:
    """Occurrences of a term that don't overlap."""
    return F.floor((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.greatest(F.length(term), F.lit(1)))


def document_form(text: Column) -> Column:
    """Extracted text: unified line ends, no control characters, single blanks, at most one blank line in a row."""
    text = F.regexp_replace(text, "\r\n?", "\n")
    text = F.regexp_replace(fold_width(text), r"[\p{Cc}&&[^\n]]", " ")
    text = F.regexp_replace(text, rf"[{SPACE}&&[^\n]]+", " ")
    text = F.regexp_replace(text, " *\n *", "\n")
    return trim(F.regexp_replace(text, "\n{3,}", "\n\n"))


def markup_text(html: Column) -> Column:
    """The text of HTML or XML: scripts and styles go, block and closing tags break the line, others part words."""
    for name in ("script", "style"):
        html = F.regexp_replace(html, rf"(?is)<\s*{name}([\s/][^>]*)?>.*?(<\s*/+{name}([\s/][^>]*)?(>|$)|$)", "\x01")
    html = F.regexp_replace(html, r"<\s*/[^>]*(>|$)", "\x01")
    html = F.regexp_replace(html, rf"(?is)<\s*({BLOCK_TAGS.replace(' ', '|')})([\s/][^>]*)?(>|$)", "\x01")
    html = F.regexp_replace(html, r"<[^>]*(>|$)", "\x02")
    for found, put in (("\n[\x01\x02]+", "\n"), ("\x02*\x01[\x01\x02]*", "\n"), ("\x02+", " ")):
        html = F.regexp_replace(html, found, put)
    for entity, char in ENTITIES:
        html = F.replace(html, F.lit(entity), F.lit(char))
    return document_form(html)


HEADING = rf"\A{SPACE}*#{{1,6}}([^#{SPACE}]|{SPACE}+[^{SPACE}])"


def heading_title(line: Column) -> Column:
    """The title of a Markdown heading, else null."""
    title = F.regexp_replace(line, rf"\A{SPACE}*#{{1,6}}", "")
    bare = trim(F.regexp_replace(trim(title), r"\A#+|#+\z", ""))
    return F.when(line.rlike(HEADING), bare)


def rust_title(line: Column) -> Column:
    """The title of a Rust item that starts on this line, else null."""
    bare = trim(line)
    item = bare.rlike(r"\A((pub )?(struct|enum|trait|fn|mod)|impl) ")
    return F.when(item, trim(F.regexp_replace(F.regexp_replace(bare, r"\{+\z", ""), r";+\z", "")))


# What a code item may begin with, and what a block that is no function begins with.
CODE_STARTS = (
    "async def |def |class |function |export function |export default function |export class |interface |type |func |public class |"
    "private class |protected class |public interface |public enum |enum |record |CREATE TABLE |CREATE VIEW |CREATE FUNCTION "
)
CONTROL_STARTS = "if |for |while |switch |catch |else |do |try "
MOST_START = max(map(len, CODE_STARTS.split("|")))


def code_title(line: Column) -> Column:
    """The title of a code item that starts on this line, else null."""
    return once(trim(line), _code_title)


def _code_title(bare: Column) -> Column:
    head = F.substring(bare, 1, MOST_START)  # told from it, for a pattern walks to the end of what it doesn't match
    comment = head.rlike(r"\A(//|#|/\*|\*)")
    binding = head.rlike(r"\A(const |let |var |export const )") & bare.rlike("=>|function")
    opens = bare.endswith("{")
    called = opens & bare.contains("(") & bare.contains(")") & ~ascii_lower(bare).rlike(rf"\A({CONTROL_STARTS})")
    shell = opens & bare.contains("()")
    title = trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"\{+\z", ""), r":+\z", ""), r";+\z", ""))
    return F.when((head.rlike(rf"\A({CODE_STARTS})") | binding | called | shell) & ~comment, title)


def extracted_heading(line: Column) -> Column:
    """Whether a line of an extracted document looks like a heading."""

    def is_heading(bare: Column) -> Column:
        numbered = bare.rlike(r"\A[0-9\x{FF10}-\x{FF19}]+[.．、)）]+[^.．、)）]")
        chinese = bare.rlike(r"\A[一二三四五六七八九十零〇][、.．)）]") | (bare.startswith("第") & F.substring(bare, 1, 8).rlike("章|节|部分"))
        return (F.length(bare) <= 120) & (numbered | chinese | bare.rlike(HEADING))

    return once(trim(line), is_heading)


def ends_sentence(line: Column) -> Column:
    bare = F.rtrim(line, F.lit(SPACES))
    return reduce(Column.__or__, (bare.endswith(end) for end in ".。!！?？;；"))

"""HTML and rich-text bills to clean text, as expressions over whole texts."""

from pyspark.sql import functions as F

# Named entities that are kept; others vanish.
ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "amp": "&"}

# Byte codes of typographic characters in rich text.
RICH_TEXT_BYTES = {
    "a0": " ", "96": "-", "97": "-", "91": "'", "92": "'", "93": '"', "94": '"',
}


def _sub(column, pattern, replacement):
    return F.regexp_replace(column, pattern, replacement)


def _tidy(text, split_lines):
    """Rules shared by both formats, in order."""
    out = F.replace(text, F.lit("\u00a0"), F.lit(" "))
    out = F.replace(F.replace(out, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    out = _sub(out, r"\[([^\]]*)\]", " $1")
    out = _sub(out, r"(\d+\.\s+[A-Z][A-Z0-9]+)\s*\n+\s*(-\s)", "$1 $2")
    if split_lines:
        out = _sub(out, r"\bINVESTMENT\s*\n(\s*CAPITAL\b)", "INVESTMENT CAPITAL")
        out = _sub(out, r"\b([A-Z]{2,4}) *\n(\s*\d+(?:,\d+)+[A-Z])", "$1  $2")
    out = _sub(out, r"\n{3,}", "\n\n")
    out = _sub(out, r"(?m)^.*H\.B\. NO\.\s+\d+.*$", "")
    return _sub(out, r"(?m)^.*S\.B\. NO\.\s+\d+.*$", "")


def _finish(text):
    return F.concat(_sub(text, r"^\s+|\s+$", ""), F.lit("\n"))


def _numeric_entities(text):
    """Decode ``&#233;`` and ``&#xe9;`` by splitting at the references."""
    parts = F.regexp_extract_all(
        text, F.lit(r"(&#[xX]?[0-9a-fA-F]+;|&(?!#[xX]?[0-9a-fA-F]+;)|[^&]+)"), F.lit(1))

    def decoded(part):
        hexa = F.regexp_extract(part, r"^&#[xX]([0-9a-fA-F]{1,6});$", 1)
        code = F.regexp_extract(part, r"^&#([0-9]{1,7});$", 1)
        number = F.when(hexa != "", F.conv(hexa, 16, 10)).when(code != "", code).try_cast("int")
        bytes_be = F.unhex(F.lpad(F.hex(number), 8, "0"))
        known = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        char = F.when(number == 160, F.lit(" ")).when(known, F.decode(bytes_be, "utf-32"))
        return F.coalesce(F.when(number.isNull(), part), char, F.lit(""))

    return F.array_join(F.transform(parts, decoded), "")


def html_to_text(html):
    """Tags stripped, breaks kept as lines, entities decoded, headers rejoined."""
    out = _sub(html, r"(?is)<!--.*?-->", "")
    # Text is skipped up to the next end tag of the three; one inside the head
    # ends the skipping there.
    out = _sub(out, r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
                    r"|<head\b[^>]*>.*?</(?:style|script|head)\s*>", "")
    out = _sub(out, r"(?i)<br\b[^>]*>|</?(p|div)\b[^>]*>", "\n")
    out = _sub(out, r"(?s)<[!/a-zA-Z?][^>]*>", "")
    for name, char in ENTITIES.items():
        if name != "amp":
            out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    out = _numeric_entities(out)
    out = _sub(out, r"&(?!amp;)[A-Za-z][A-Za-z0-9]*;", "")
    out = F.replace(out, F.lit("&amp;"), F.lit("&"))
    return _finish(_tidy(out, split_lines=True))


def rtf_to_text(rtf):
    """Control words and groups dropped, byte escapes decoded."""
    out = rtf
    for group in ("fonttbl", "colortbl", r"\*\\expandedcolortbl"):
        out = _sub(out, r"\{\\" + group + r"[^}]*\}", "")
    out = F.replace(out, F.lit("\\\n"), F.lit("\n"))
    for code, char in RICH_TEXT_BYTES.items():
        out = _sub(out, rf"(?i)\\'{code}", char)
    pieces = F.regexp_extract_all(
        out, F.lit(r"(?s)(\\'[0-9a-fA-F]{2}|\\(?!'[0-9a-fA-F]{2})|[^\\]+)"), F.lit(1))

    def decoded(piece):
        code = F.regexp_extract(piece, r"^\\'([0-9a-fA-F]{2})$", 1)
        number = F.conv(code, 16, 10).try_cast("int")
        printable = number.between(0x20, 0x7E)
        return F.when(code == "", piece).when(printable, F.char(number)).otherwise(F.lit(" "))

    out = F.array_join(F.transform(pieces, decoded), "")
    out = _sub(out, r"\\[a-zA-Z]+[-\d]*[ ]?", "")
    out = _sub(out, r"[{}]", "")
    out = _tidy(out, split_lines=False)
    out = _sub(out, r"(?im)^(\s*[A-Z]{2,4}\s.*[A-Za-z])\"$", "$1")
    return _finish(out)

"""Reference patterns in Java syntax, compact (no comment mode), case-insensitive, Unicode-aware."""

# The grammar of numbers, ranges and series, and a pattern for each kind of reference. The order of kinds is free: mentions are sorted afterwards.
NUM = r"\d+(?:\.\d+)*[A-Za-z]?"
RANGE = rf"{NUM}(?:\s*[-–—]\s*{NUM})?"
SERIES = rf"{RANGE}(?:\s*(?:,|and|&|to)\s*{RANGE})*"
FLAGS = "(?iU)"
PATTERNS = {
    "appendix": rf"{FLAGS}\bappendix[ \t]*[A-Za-z](?:\.\d+)*\b",
    "equation": rf"{FLAGS}\b(?:equations?|eqs?\.?)[ \t]*\(?{SERIES}\)?",
    "figure": rf"{FLAGS}\b(?:figures?|figs?\.?)[ \t]*{SERIES}",
    "footnote": rf"{FLAGS}\b(?:footnotes?|fn\.?)[ \t]*\d+",
    "line": rf"{FLAGS}(?<![A-Za-z])(?:(?:lines?|l\.)\s*\(?\d+(?:\s*(?:[-–—]|to)\s*\d+)?\)?|l\d{{2,}}(?:\s*[-–—]\s*l?\d+)?)",
    "page": rf"{FLAGS}(?<![A-Za-z])(?:pages?|pp?\.?)[ \t]*\d+(?:\s*[-–—]\s*\d+)?",
    "section": rf"{FLAGS}(?:\bsections?|\bsecs?\.?|§)[ \t]*{SERIES}|\b(?:introduction|related\s+work|method(?:s|ology)?|approach|experiments?|results?|analysis|discussion|limitations?|conclusion|ablation|future\s+work)\s+section\b",
    "table": rf"{FLAGS}\b(?:tables?|tabs?\.?)[ \t]*{SERIES}",
}
#: What a text has to hold in folded case for a pattern to match; all kinds but those of NO_DIGIT need a digit as well.
NEEDS = {"appendix": ("appendix",), "equation": ("eq",), "figure": ("fig",), "footnote": ("footnote", "fn"), "line": ("l",), "page": ("p",), "section": ("sec", "§"), "table": ("tab",)}
NO_DIGIT = ("appendix", "section")
#: How every match of a pattern begins: looked at before word bounds and what stands before, which cost most. s and i stand outside classes (ſ, ı and İ fold to them).
BEGINS = {"appendix": "ap", "equation": "eq", "figure": "fi", "footnote": "f[on]", "line": r"li|l[.\d]", "page": r"p[ap.\d \t]", "section": "[rmaedlcf][enpxoabu]|di|li|se|§|in", "table": "ta"}
# Words before a label, abbreviations, starts of headings, list items and quotes.
PREFIX = rf"{FLAGS}^\s*(?:section|sec|§|table|tab|figure|fig|appendix|equation|eq|lines?|l|page|pp?|footnote|fn)s?\.?\s*"
#: As PREFIX, but a bare "l" is a prefix before a digit only (PREFIX turns "Limitations" into "imitations").
SAFE_PREFIX = PREFIX.replace("|l|", r"|l(?=\.?\s*\(?\d)|")
STAT_PREFIX = rf"{FLAGS}^(?:lines?|l\.?|sections?|secs?\.?|§|tables?|tabs?\.?|figures?|figs?\.?|appendix|equations?|eqs?\.?|pages?|pp?\.?|footnote)\s*"
ABBREVIATIONS = r"\b(?:e\.g\.|i\.e\.|etc\.|vs\.|et al\.)"
HEADING = r"(?m)^\s{0,3}#{1,6}\s+"
LIST_ITEM = r"(?m)^\s*(?:>\s*)?(?:[*\-+]|\d+[.)])\s+"
QUOTE = r"(?m)^\s*>\s+"
LIST_NUMBER = r"^\s*(?:>\s*)?\d+\.$"
STAT_TYPES = {"line": "paragraph"}
MAIN_TYPES = ("paragraph", "section", "figure", "table")
SECTION_HEADER = r"^\s*(?:(\d{1,2}(?:\.\d{1,2})*)\s+([A-Z][^\n]{0,120})|Appendix\s+([A-Z])(?:\s+([A-Z][^\n]{0,120}))?)\s*$"
UNNUMBERED = r"(?i)^(?:limitations?|ethics|ethical\s+considerations?|ethics\s+statement|ethical\s+statement|broader\s+impact)\s*$"

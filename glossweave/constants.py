"""Values that have to be exactly these for results to be right."""

# --- fixed values: headings of sections that hold no definitions ------------
EXCLUDED_SECTIONS = (
    "Traduccions",
    "Miscel·lània",
    "Vegeu també",
    "Translations",
    "Miscellany",
    "See also",
    "References",
    "Referéncias",
    "Traduccions_2",
    "Traduccions_3",
)

# --- fixed values: inclusive code point ranges per writing system -----------
# The order matters: a character belongs to the first script that lists it.
SCRIPTS = (
    ("latin", ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xFF), (0x100, 0x17F), (0x180, 0x24F))),
    ("cyrillic", ((0x400, 0x4FF), (0x500, 0x52F))),
    ("greek", ((0x370, 0x3FF),)),
    ("chinese", ((0x4E00, 0x9FFF), (0x3400, 0x4DBF))),
    ("japanese", ((0x3040, 0x309F), (0x30A0, 0x30FF), (0x4E00, 0x9FFF))),
    ("korean", ((0xAC00, 0xD7AF), (0x1100, 0x11FF))),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F))),
    ("hebrew", ((0x590, 0x5FF),)),
    ("devanagari", ((0x900, 0x97F),)),
    ("thai", ((0xE00, 0xE7F),)),
)

# --- fixed values: language code to the name used on pages and in headers ---
LANGUAGE_NAMES = {
    "en": "English",
    "ru": "Russian",
    "ca": "Català",
    "oc": "Occitan",
    "fr": "Français",
    "es": "Spanish",
    "de": "German",
    "it": "Italian",
    "pt": "Portuguese",
    "uk": "Ukrainian",
    "be": "Belarusian",
    "nl": "Dutch",
    "pl": "Polish",
    "cs": "Czech",
    "sv": "Swedish",
    "da": "Danish",
    "no": "Norwegian",
    "fi": "Finnish",
    "hu": "Hungarian",
    "el": "Greek",
    "tr": "Turkish",
    "ar": "Arabic",
    "he": "Hebrew",
    "hi": "Hindi",
    "zh": "Chinese",
    "ja": "Japanese",
    "ko": "Korean",
}

# --- fixed values: framing lines of the two output formats ------------------
DSL_CHARSET = "#CHARSET UTF-8"
XDXF_PROLOG = '<?xml version="1.0" encoding="UTF-8" ?>'
XDXF_DOCTYPE = (
    '<!DOCTYPE xdxf SYSTEM "https://raw.github.com/soshial/'
    'xdxf_makedict/master/format_standard/xdxf_strict.dtd">'
)
XDXF_DESCRIPTION = "<description>Converted from Wiktionary</description>"

# White space as str.isspace() sees it, listed once for trimming and once as a
# character class that Java and RE2 read alike.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
SPACE_CLASS = (
    r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# Runs of white space other than one plain space: all that tidying has to touch.
# The Unicode property is a cheaper test in Java than the list of ranges above.
UNTIDY_SPACES = r"(?U)[\s\x1c-\x1f&&[^ ]][\s\x1c-\x1f]*| [\s\x1c-\x1f]+"
# Any place that tidying changes: these runs, a space after "(", one before ")" or punctuation.
UNTIDY = r"(?U)[\s\x1c-\x1f(](?:(?<=[^ (])|(?<= )[\s\x1c-\x1f),.;:!?]|(?<=\() )"

"""Regular-expression classes and word lists. Results depend on each of them as it stands."""

# fixed values
MARKS = r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}\x{200C}\x{200D}\x{200F}]"
WORD = r"[\p{L}\p{N}_\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}]"
DEVANAGARI = r"[\x{0900}-\x{097F}]"
ARABIC_ONLY = r"[\x{0629}\x{064A}\x{0643}\x{0649}\x{0625}\x{0623}\x{064B}-\x{0652}]"
ARABIC_LETTERS = r"[\x{0629}\x{064A}\x{0643}\x{0649}\x{0625}\x{0623}]"
LATIN = r"[A-Za-z]"
WS = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
INVENTED = r"(?iu)اشترك|القناة|سبسکرائب|سبسکرائیب|ترجمة|subscribe|subtitles"
LETTERS_FROM = "يىكةۃهأإۓ"
LETTERS_TO = "ییکہہہااے"
TOKEN_MARKS = r"""[،۔؟؛٫!?.,:;"'«»()\[\]{}—–\-…]"""
SENTENCE_END = r"(۔|؟|!|\?|\.|۔»)$"
SINGLE_LETTER_WORDS = ("و", "آ", "ء")
FRAGMENT_END = r"[۔،؟:؛.,]$"
# end of fixed values

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
#: Digits of other scripts that a number may be written in.
DIGITS_FROM = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
DIGITS_TO = "01234567890123456789"

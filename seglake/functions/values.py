"""Fixed values. Thresholds in milliseconds unless named otherwise."""

PUNCTUATION = [".", "!", "?", "。", "！", "？"]
ENDINGS_KO = [
    "니다", "십시오", "어요", "아요", "여요", "해요", "워요", "와요", "봐요", "세요", "예요", "에요", "래요", "게요",
    "네요", "군요", "는군요", "구나", "죠", "지요", "았다", "었다", "였다", "겠다",
]
NON_ENDINGS_KO = [
    "니까", "는데", "ㄴ데", "다가", "다고", "다면", "라고", "라며", "면서", "으며", "어서", "아서", "지만", "거나",
    "든지", "으로", "로", "에서", "에게", "부터", "까지", "보다", "처럼", "만큼", "이나", "라는", "다는",
]
ABBREVIATIONS_EN = [
    "mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "mt", "rev", "hon", "gen", "col", "sgt", "capt", "lt", "gov",
    "sen", "rep", "pres", "dept", "univ", "etc", "eg", "ie", "vs", "al", "cf", "viz", "et", "am", "pm", "no", "vol",
    "pp", "fig", "ch", "sec", "min", "hr", "us", "uk", "un", "eu", "usa", "dc", "inc", "ltd", "co", "corp", "llc",
    "plc", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec",
]
STUB_STOPWORDS = [
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "at", "for", "with", "from", "by", "is", "are", "was",
    "were", "be", "been", "i", "we", "you", "it", "he", "she", "they", "this", "that", "these", "those", "my", "our",
    "your", "their", "its", "his", "her", "as", "so", "but", "if", "then", "u", "s", "t",
]
EDGE_PUNCTUATION = ".,?!…~\"'`“”‘’()[]{}<>:;·-–—。、，！？ \t"
# closed and known unclosed annotations, note signs
ANNOTATION = (
    r"\([^)]*\)|\[[^\]]*\]"
    r"|\((?:speaking|laughter|applause|music|singing|coughs?|sighs?|noise|sound)[A-Za-z' .]*\)?"
    r"|\[[A-Z][A-Za-z_ .]*\]?|[♪♩♫♬]"
)
# CJK ideographs, extension A, radicals, Kangxi, compatibility, Hiragana, Katakana
CJK_KANA = "[一-鿿㐀-䶿⺀-⻿⼀-⿟豈-﫿぀-ゟ゠-ヿ]"
HANGUL = "[가-힣]"
LATIN = "[A-Za-z]"
WORD_TOKEN = "[A-Za-z']+|[가-힣]+"
FOREIGN_MARKER = r"\(speaking in foreign language"

TAIL_EPS_MS = 50
TAIL_LOOKBACK_MS = 1500
FINALIZE_GRACE_MS = 2000
RETRACT_EPS_MS = 50
SAME_SCRIPT_ZONE_MS = 1200
SILENCE_HARD_MS = 1200
PENDING_CAP_MS = 2000
MIN_SPEAKER_MS = 500
LONG_SILENCE_MS = 2000
SHORT_SILENCE_MS = 500
STALL_MS = 10_000
REEMIT_TOL_MS = 400
NEAR_LINES = 30

"""Patterns and word lists whose values are fixed by the data format, and their form for the JVM.

Everything under "Fixed values" must be as it is for results to be right; it is
written as regular expressions with Unicode classes (``\\w``, ``\\d``, ``\\s``,
``\\b``) and look-around. ``jvm`` spells the classes out, as those of the JVM
differ: there combining marks count as word characters.
"""

from __future__ import annotations

WORD = r"\p{L}\p{N}_"
SPACE = "\t-\r\x1c-\x20\x85\xa0  -     　"
LINE_END = "\r\n|[\n-\r\x1c-\x1e\x85  ]"

# Token patterns ------------------------------------------------------------------------------------
EXTENSIONS = "pdf|jsonl|csv|txt|xml|yaml|yml|ini|cfg|log|py|ps1|sh|exe|dll|bin|hex|gxw|gx3|prx"
PATH_START = r"(?:[A-Za-z]:\\|\\\\)"
PLACEHOLDER = r"\{\{[^{}\r\n]+\}\}|\{[A-Za-z_][\w.-]*\}|\$\{[A-Za-z_][\w.-]*\}|\$[A-Za-z_][\w.-]*|%(?:\d+|[sdif])"
TAG = r"<(/?)([A-Za-z][A-Za-z0-9:_-]*)(?:\s[^<>]*?)?(/?)>"
URL = r"(?i)https?://[^\s<>\"']+"
WINDOWS_PATH = (
    rf"(?i)(?<![A-Za-z0-9])(?:{PATH_START}[^<>:\"/|?*;\r\n]{{1,240}}?\.(?:{EXTENSIONS})(?=$|[\s,;:!?\)\]\}}\"'”’])"
    rf"|{PATH_START}[^\s<>\"|?*]+)"
)
POSIX_PATH = r"(?<![\w:])(?:\.{0,2}/|/)[\w.-]+(?:/[\w.-]+)+"
FILE_NAME = rf"(?i)(?<![\w.-])[\w.-]+\.(?:{EXTENSIONS})(?![\w.-])"
DOCUMENT_LABEL = r"(?<!\w)Page\s+No\.?(?!\w)"
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
IPV4 = rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?![\d.])"
ENDPOINT = r"(?<![A-Za-z0-9])(?:TCP|UDP)/\d{1,5}(?![A-Za-z0-9])"
IDENTIFIER = (
    r"(?<![A-Za-z0-9_])(?:0x[0-9A-Fa-f]+|[A-Z]{1,3}\[\d+\]|(?:ZR|D|M|X|Y|R|P|Z|B|W|L|F|V)\d+|(?:AL|ERR|ER|E)[.-]\d+|(?:OK|NG)#\d+|PCW|(?:CN|COM)\d+"
    r"|(?=[A-Z0-9][A-Z0-9._/-]{3,})(?=[A-Z0-9._/-]*[A-Z])(?=[A-Z0-9._/-]*\d)[A-Z0-9]+(?:[._/-][A-Z0-9]+)*)(?![A-Za-z0-9_])"
)
STANDARD = r"(?<![A-Za-z0-9])(?:ISO|IEC|EN|KS|DIN|JIS)\s+[A-Z]?\s*\d+(?:-\d+)*(?::\d{4})?(?![A-Za-z0-9])"
VERSION = r"(?<![A-Za-z0-9])(?:Rev\.[A-Za-z0-9]+|v\d+(?:\.\d+){1,3})(?![A-Za-z0-9])"
DOCUMENT_ID = r"\b(?:SPEC|DWG|Document)\s+No\.\s*[A-Za-z0-9._/-]+|\b(?:P/N|S/N|ECN|ECR|LOT)\s*:?\s*[A-Za-z0-9._/-]+"
NUMBER = r"(?<![A-Za-z0-9_.])[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?![A-Za-z0-9_]|\.\d)"
RANGE = r"(?<![A-Za-z0-9_.])[-+]?(?:\d+(?:\.\d+)?)\s*(?:±|–|-)\s*[-+]?(?:\d+(?:\.\d+)?)(?![A-Za-z0-9_.])"
KOREAN_RANGE = r"(?<![A-Za-z0-9_.])[-+]?(?:\d+(?:\.\d+)?)\s*(?:±|–|-|~|～)\s*[-+]?(?:\d+(?:\.\d+)?)(?![A-Za-z0-9_]|\.\d)"
UNITS = r"VAC|VDC|mA|MPa|kPa|Pa|N·m|N\.m|mm/s|m/s|rpm|kHz|Hz|ms|µs|μs|°C|mm|cm|kW|W|sec|%"
UNIT = rf"(?<![A-Za-z0-9])(?:{UNITS})(?![A-Za-z0-9])"
QUANTITY = rf"(?<![A-Za-z0-9_.])([-+]?(?:\d+(?:\.\d+)?))\s*({UNITS})(?![A-Za-z0-9])"
SINGLE_LETTER_QUANTITY = r"(?<![A-Za-z0-9_.])[-+]?(?:\d+(?:\.\d+)?)\s*(?:V|A|N|m)(?![A-Za-z0-9])"
POLARITY = r"(?<![A-Za-z0-9])(?:ON|OFF)(?![A-Za-z0-9])"
OPCODE = r"(?<![A-Za-z0-9_])(?:DFROM_M|DTO_M|MOV|BMOV|SET|RST|CASE|IF|THEN|TON|MOVJ|MOVL|NWAIT)(?![A-Za-z0-9_])"
OPERAND = r"(?:0x[0-9A-Fa-f]+|[A-Z]{1,3}\[\d+\]|[A-Z]{1,3}\d+|[-+]?\d+(?:\.\d+)?)"
STATEMENT = rf"(?<!\w)(?:(?:DFROM_M|DTO_M|MOV|BMOV|SET|RST|TON|MOVJ|MOVL)(?:[ \t]+{OPERAND})+(?!\w)|NWAIT(?!\w))"
CONDITIONAL = r"IF\s+[A-Za-z_][\w.]*\s+THEN\s+"
SYNTAX = r"/\*|\*/|//|[;$*\[\]{}]"
INLINE_CODE = r"`([^`\r\n]+)`"
STYLE_TAG = r"(?i)</?s[123]>"
FORMULA_TAG = r"(?i)</?b\d+>|\{\s*v[\d\s]+\}"
MASK_TAG = r"</?b(\d+)>"
SHORT_TOKEN_RUN = r"(?i)(?<!\w)(\w{1,3})(?:[ \t]+\1){3,}(?!\w)"
REPEATED_CHAR_RUN = r"([^\w\s])\1{3,}"
NUMBER_ABBREVIATION = r"(?<![A-Za-z])no\.(?=\s*\d)"
SENTENCE_TOKEN = r"[^\W_]+(?:[-/][^\W_]+)*"

# Associations of objects and values -----------------------------------------------------------------
NAMED_OBJECT = r"(?i)\b(?:(?:axis|trục)\s+([XYZABC]|\d+)|([XYZABC])\s*(?:axis|축|轴|軸)|(?:parameter|tham số|参数|參數|파라미터)\s+(\d+))\b"
ASSOCIATED_VALUE = r"[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?!\w|\.\d)"
VALUE_AFTER = rf"(?i)\s*(?:(?:=|:)|(?:to|at|is|thành|bằng|là)|(?:값을|값은|값|을|를|은|는))?\s*({ASSOCIATED_VALUE})"
VALUE_BEFORE = rf"(?i)(?<![\w.])({ASSOCIATED_VALUE})\s+(?:cho|vào|to|into)\s*$"
BEFORE_WINDOW = 50

# Cues of meaning in a source, and what answers them in Vietnamese -----------------------------------
CUES = [
    ("prohibition", r"(?i)\b(?:do not|must not|shall not|never|is not permitted|is not allowed)\b|하지\s*마|금지|禁止|不得|严禁|嚴禁|请勿|請勿|切勿", r"(?i)\b(?:không|cấm|đừng)\b"),
    ("mandatory", r"(?i)\b(?:must|shall)\b(?!\s+not\b)|반드시|하여야\s*한다|해야\s*한다|必须|必須", r"(?i)\b(?:phải|bắt buộc|nhất thiết)\b"),
    ("recommended", r"(?i)\b(?:should|recommended)\b|권장|建议|建議", r"(?i)\b(?:nên|khuyến nghị|khuyến cáo)\b"),
    ("permission", r"(?i)\b(?:is permitted|is allowed)\b", r"(?i)\b(?:được phép|cho phép|có thể)\b"),
]
KOREAN_CUES = [
    ("need", r"(?<![가-힣])필요(?:함|하다|합니다|한|가|는)?(?=$|[^가-힣])", r"(?i)\b(?:cần|cần thiết|yêu cầu)\b"),
    ("mandatory", r"(?<![가-힣])(?:반드시|필수(?:임|입니다|인|가|는)?)(?=$|[^가-힣])|(?:해야|하여야)\s*(?:함|한다)(?=$|[^가-힣])", r"(?i)\b(?:phải|bắt buộc|nhất thiết)\b"),
    ("recommended", r"(?<![가-힣])(?:권장|권고)(?:함|하다|합니다|한다|됨|됩니다)?(?=$|[^가-힣])", r"(?i)\b(?:nên|khuyến nghị|khuyến cáo)\b"),
    ("prohibition", r"(?<![가-힣])금지(?:됨|입니다|함)?(?=$|[^가-힣])|하지\s*(?:마십시오|말\s*것)", r"(?i)\b(?:không|cấm|đừng)\b"),
    ("possible", r"(?<![가-힣])가능(?:함|하다|합니다|한)?(?=$|[^가-힣])|할\s*수\s*있음(?=$|[^가-힣])", r"(?i)\b(?:có thể|được phép|khả thi)\b"),
    ("impossible", r"(?<![가-힣])불가(?:함|하다|합니다|한)?(?=$|[^가-힣])|할\s*수\s*없음(?=$|[^가-힣])", r"(?i)\b(?:không thể|không được phép|bất khả thi)\b"),
    ("condition", r"(?<![가-힣])경우(?:에|에는|가|엔)?(?=$|[^가-힣])", r"(?i)\b(?:nếu|khi|trong trường hợp)\b"),
    ("first", r"(?<![가-힣])먼저(?![가-힣])", r"(?i)\b(?:trước tiên|đầu tiên|trước)\b"),
]
AFFIRMATIVE_CUES = ["need", "mandatory", "recommended", "possible"]
NEGATED_BEFORE = r"(?i)\bkhông(?:\s+\w+){0,2}\s*$"
NEGATED_WINDOW = 40
ORDER_WORD = r"(?i)\b(before|after|trước khi|sau khi|trước|sau)\b"
KOREAN_ORDER_WORD = r"(?<![가-힣])(이전|이후|전|후)(?![가-힣])"
KOREAN_ACTION = "검수|시운전|완료|검사|확인|작성|설정|변경|운전|가동|누르|시작|종료|복귀|점검"
RESPONSE_NEEDED = "대응.*(?<!불)필요"
RESPONSIBLE_SOURCE = "담당|책임"
RESPONSIBLE_TARGET = r"(?i)chịu\s+trách\s+nhiệm|người\s+phụ\s+trách|trách\s+nhiệm"
AMBIGUOUS_KOREAN = "검수|시운전|대응|공용화"
ASCII_WORD = r"(?<!\w)[A-Za-z][A-Za-z0-9]*(?:[ /&.-]+[A-Za-z0-9]+)*(?!\w)"

# English inside Korean text ---------------------------------------------------------------------------
KEPT_TERMS = ["Servo Motor", "SCARA Robot", "Interlock"]
KEPT_IN_CONTEXT = [
    ("Manual", "검수|작성|문서|항목|내용|준비|참조|확인"),
    ("Utility", "공사|설비|장비|공장|배관|전원|공급|연결|시공|현장"),
    ("Qualification", "설비|장비|공정|수행|검증|인증|평가"),
]
UI_LABELS = [
    r'["“]\s*([A-Za-z][A-Za-z0-9 _./:&()+-]{0,79}?)\s*["”]',
    r"(?<![A-Za-z0-9_])([A-Z][A-Za-z0-9]*(?:[ \t]+[A-Z][A-Za-z0-9]*){0,4})(?=\s*(?:버튼|메뉴|패널|창|화면|체크박스|모드|항목))",
    r'(?<![A-Za-z0-9_])([A-Z][A-Za-z0-9]*(?:[ \t]+[A-Z][A-Za-z0-9]*){0,3}[ \t]+(?:Panel|Window|Button|Menu|Mode|Option|Data))(?=\s*(?:[)\]"”]|[가-힣]|$))',
    r"^\s*(?:[-•■□▪]\s*)?([A-Z][A-Za-z0-9]*(?:[ \t]+[A-Z][A-Za-z0-9]*){0,4})\s*:",
]
ACRONYM = r"(?<!\w)[A-Z]{2,8}(?:/[A-Z0-9]{1,8})?(?!\w)"

# Routing ------------------------------------------------------------------------------------------------
ROUTING_HAN = "[㐀-鿿]"
LATIN_WORD = "[A-Za-z]{2,}"
UI_WORD = r"(?i)(?<![A-Za-z0-9_])(?:Start|Stop|Reset|Run|Open|Close|OK|Cancel|ON|OFF|Enable|Disable|Enter|Exit)(?![A-Za-z0-9_])"
NEGATION = r"(?i)\b(?:not|never|must\s+not|do\s+not|prohibit(?:ed|ion)?)\b|(?:금지|않|말아야|不得|禁止|不要)"
MODALITY = r"(?i)\b(?:must|required|necessary|recommended|possible|permitted|shall)\b|(?:필수|필요|권장|가능|해야|必须|需要|建议|允许)"
CONDITION = r"(?i)\b(?:if|when|in\s+case|unless)\b|(?:경우|때|하면|如果|当|若)"
ORDER = r"(?i)\b(?:before|after|then|first|next|finally|prior\s+to)\b|(?:전에|후에|다음|먼저|이후|之前|之后|然后|首先)"
ROUTING_OBJECT = r"(?i)\b(?:axis\s+[A-Z0-9]+|port(?:\s+No\.)?\s*\d+|(?:D|M|X|Y|R|ZR)\d+|channel\s*\d+|parameter\s+[A-Z0-9._-]+)\b"
ROUTING_VALUE = r"(?i)(?<![A-Za-z])[-+]?\d+(?:\.\d+)?(?:\s*(?:mm/s|m/s|rpm|kHz|Hz|ms|sec|s|V|A|mA|MPa|kPa|Pa|mm|cm|%|°C))?|\b(?:TCP|UDP|ON|OFF)\b"

# Metadata of headers and footers ------------------------------------------------------------------------
METADATA = {
    "document_code": r"\b[A-Z]{2,}(?:-[A-Z0-9]+){2,}\b",
    "revision": r"(?i)\bRev\.\s*:?\s*\d+(?:\.\d+)+\b",
    "page_number": r"\b\d{1,4}\s*/\s*\d{1,4}\b",
    "date": r"\b(?:19|20)\d{2}[.-]\s*\d{1,2}[.-]\s*\d{1,2}\b",
    "time": r"\b(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d\b",
    "author_id": r"\b[A-Z]{2,}[A-Z0-9]*\d{2,}\b",
    "confidential": r"(?i)CONFIDENTIAL(?:\s+\d{4})?",
}
RESIDUAL_CJK = "[㐀-䶿一-鿿가-힣]"

# What needs no translation ---------------------------------------------------------------------------------
TECHNICAL_ONLY = (
    r"(?i)(?<![A-Za-z0-9_])(?:0x[0-9A-Fa-f]+|(?:ZR|D|M|X|Y|R|P|Z|B|W|L|F|V)\d+|[A-Z]{1,3}\[\d+\]|(?:AL|ERR|ER|E)[.-]\d+|(?:TCP|UDP)/\d{1,5}"
    r"|(?-i:(?=[A-Z0-9][A-Z0-9._/-]{3,})(?=[A-Z0-9._/-]*[A-Z])(?=[A-Z0-9._/-]*\d)[A-Z0-9]+(?:[._/-][A-Z0-9]+)*[a-z]?)|ISO\s+\d+(?:-\d+)*(?::\d{4})?"
    r"|[-+]?\d+(?:\.\d+)?\s*(?:W|kW|V|A|N|m|mA|MPa|kPa|Pa|mm|cm|mm/s|m/s|rpm|kHz|Hz|ms|sec|s|µs|μs|°C|N·m|N\.m|Ω|%)"
    r"|(?:VAC|VDC|N|m|mA|MPa|kPa|Pa|mm|cm|mm/s|m/s|rpm|kHz|Hz|ms|sec|s|µs|μs|°C|N·m|N\.m|Ω|%)|PLC|I/O|JOG|Servo\s+ON|FOB|CAD|ON|OFF|OK|NG|O|X)(?![A-Za-z0-9_])"
)
STANDALONE_TERM = (
    r"(?i)(?:PLC|HMI|Servo|Servo\s+Motor|Encoder|Interlock|JOG|Servo\s+ON|SCARA\s+Robot|Linear\s+Motor|Buffer\s+C/V|Pick\s*&\s*Place"
    r"|BCR|(?:2D\s+)?CCD|FFU|PCW|Utility|Check\s+Sheet|Spare\s+Parts|C/V|Page\s+No\.?)"
)
BETWEEN_CODES = r"[\s,;:|/()\[\]{}.+\-=×±≤≥]+"
FORMULA_ONLY = r"\{v\d+\}"
CACHE_TAG = r"(?i)\{v\d+\}|</?[bs]\d+>"
SHARED_WORD = "[A-Za-z㐀-鿿가-힣]+"
CLOSED = r"[.!?:。！？]\s*$"
ROTATED_LABEL = r"(?i)\b(ref|no|rev|code|version)\b"
ROTATED_HEADERS = {"Designation": "Tên gọi", "Abbreviation": "Viết tắt", "Unit": "Đơn vị"}
FORMULA_FONT = (
    r"(CM[^R]|MS.M|XY|MT|BL|RM|EU|LA|RS|LINE|LCIRCLE|TeX-|rsfs|txsy|wasy|stmary|.*Mono|.*Code|.*Sym|.*Math|.*Typewriter|Cousine|Consolas|Menlo"
    r"|Monaco|Inconsolata|Source.?Code|Fira.?Code|DejaVu.?Sans.?Mono|Liberation.?Mono|Courier)"
)
BULLETS = "•■□▪▸▹►▶●○◆◇★☆‣⬤"
PRIVATE_BULLETS = ""
SYMBOL_FONT = r"(?i)wingdings|webdings|symbol|dingbats"
MATH_OPERATOR = "[=≤≥≈≠±×÷·∑∫√∞∝+*/^]"
MATH_FUNCTION = r"(?i)(?<![A-Za-z])(?:sin|cos|tan|cot|sec|csc|log|ln|exp|min|max|lim|det|mod)(?![A-Za-z])"
PROSE_WORD = "[a-z]{3,}"
CJK_PROSE = r"[가-힣㐀-鿿]{2,}|(?:[A-Za-z]{2,}|\d+)[가-힣]+"
STACKED_TOKEN = "[A-Za-zͰ-Ͽ][A-Za-zͰ-Ͽ0-9%]*"
MATH_WORD = r"(?i)(?<![A-Za-z])(?:ln|log|lim|sin|cos|tan|cot|sec|csc|exp|max|min|mod|sqrt|rad|deg|fnc|fnt|fn)(?![A-Za-z])"
MATH_ONLY = "^[0-9+\\-*/=()<>\\[\\]{},._:;^√∫∑∞≤≥≠±∓×÷%'\"\\\\|\\s⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻₀₁₂₃₄₅₆₇₈₉₊₋′″‴°·∙–—~]*$"
MATH_MARKER = "[Ͱ-Ͽ⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻₀₁₂₃₄₅₆₇₈₉₊₋′″‴∙√∞µ]"
MATH_SIGN = r"[=/^√≤≥≠±∈∉⊂⊃∩∪]"
SYMBOL_LENGTH, FORMULA_LENGTH = 16, 60
OPTION_LABEL = r"^([(]?[A-Da-d1-9][.)])\s*"
STRAY_TAGS = [r"(?i)<\s*/?\s*b\s*\d+\s*>", r"(?i)<\s*/?\s*s\s*[123]\s*>", r"(?i)\{\s*v\s*\d+\s*\}"]
RAISED, LOWERED, FIGURES = "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻", "₀₁₂₃₄₅₆₇₈₉₊₋", "0123456789+-"
LEADER = r"(?:\.{2,}|[․‥…─-╿�\x08]{2,})"
LOCATOR = r"(?i)(?:\d{1,4}|[ivxlcdm]+)[,;:.-]?"
SECTION_NUMBER = r"(?i)(?:\d+(?:\.\d+)*|[ivxlcdm]+)[.)]?"
CITATION = r"(?i)(?:^\s*(?:\[\d{1,3}\]|\d{1,3}\.\s|[A-Z][a-z]+,?\s.*\(\d{4}\))|(?:DOI|ISBN|ISSN)\b|https?://)"
MARKERS = ["대외비", "CONFIDENTIAL", "INTERNAL", "RESTRICTED"]
LINE_HEIGHT = {"zh-cn": 1.4, "zh-tw": 1.4, "zh-hans": 1.4, "zh-hant": 1.4, "zh": 1.4, "ja": 1.1, "ko": 1.2, "en": 1.2, "ar": 1.0, "ru": 0.8, "uk": 0.8, "ta": 0.8}
# Failures by the first marker that their lower-cased description holds.
ERRORS = [
    ("E-CORE-01", ["pikepdf", "_core", "extension library", "DLL load failed", "ImportError", "ModuleNotFoundError"]),
    ("E-OUT-05", ["already exists", "Output already exists"]),
    ("E-PDF-02", ["FzErrorSyntax", "damaged beyond repair", "Could not repair", "invalid key in dict", "FzErrorFormat", "PdfError"]),
    ("E-PDF-01", ["does not exist", "must have a .pdf extension", "does not contain a PDF header"]),
    ("E-PDF-03", ["scanned", "image-only", "OCR", "no extractable text"]),
    ("E-NET-04", ["ConnectionError", "Timeout", "timed out", "HTTPError", "SSLError", "Max retries", "getaddrinfo", "Google Translate", "RetryError"]),
    ("E-MEM-06", ["MemoryError", "not enough memory", "Cannot allocate"]),
]
# Reasons of failures folded into what a reader is told; the first that fits, else "engine".
DIGEST = [("fit", ["font size", "cannot fit"]), ("formula", ["FormulaPlaceholderError"]), ("too_long", ["SegmentTooLongError"]), ("invariant", ["TechnicalInvariantError"]), ("unresolved", ["UnresolvedSegmentError"])]
# Errors by how often they are tried again.
CONTENT_ERRORS = ["VerifiedProperNameError", "TechnicalInvariantError", "FormulaPlaceholderError", "TranslationIntegrityError", "TerminologyConsistencyError"]
BUDGETS = {"pre_provider": 1, "content": 8, "transport": 8}


def jvm(pattern: str) -> str:
    """The pattern with Unicode classes spelled out, and line feeds as the only line ends, for the regular expressions of the JVM."""
    flags, out, i, inside = "d", [], 0, False
    if pattern.startswith("(?i)"):
        flags, i = "diu", 4
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            e = pattern[i + 1]
            i += 2
            if e == "w":
                out.append(WORD if inside else f"[{WORD}]")
            elif e == "d":
                out.append(r"\p{Nd}")
            elif e == "s":
                out.append(SPACE if inside else f"[{SPACE}]")
            elif e == "S" and not inside:
                out.append(f"[^{SPACE}]")
            elif e == "W" and inside:  # only as [^\W_]: letters and figures
                out.append("\\W")
            elif e == "b" and not inside:
                out.append(f"(?:(?<![{WORD}])(?=[{WORD}])|(?<=[{WORD}])(?![{WORD}]))")
            else:
                out.append("\\" + e)
            continue
        if c == "[" and not inside:
            inside = True
            if pattern.startswith(r"[^\W_]", i):
                out.append(r"[\p{L}\p{N}]")
                i, inside = i + 6, False
                continue
        elif c == "[":
            c = r"\["
        elif c == "]":
            inside = False
        out.append(c)
        i += 1
    return f"(?{flags})" + "".join(out)

"""Fixed values.

Word lists, lookup tables, patterns, messages and constants below are data:
results are only right when they are exactly these, so they are kept together
and written out as they are. The operators hold the logic.

Patterns are Java regular expressions. ``(?U)`` makes ``\\d \\s \\w`` Unicode
aware and ``(?d)`` lets ``.`` stop at ``\\n`` only.
"""

# --- fixed values: characters ------------------------------------------------
ARABIC_INDIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
EASTERN_ARABIC_INDIC_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
WESTERN_DIGITS = "0123456789"
ARABIC_SEPARATORS = "٫٬"  # decimal, thousands
WESTERN_SEPARATORS = ".,"

DIACRITIC_RANGES = [(0x0610, 0x061A), (0x064B, 0x065F), (0x0670, 0x0670), (0x06D6, 0x06ED)]
TATWEEL = "ـ"
LETTER_VARIANTS = "آأإٱةىؤئ"  # آ أ إ ٱ ة ى ؤ ئ
LETTER_TARGETS = "ااااهيوي"  # ا ا ا ا ه ي و ي

ARABIC_LETTER_CLASS = r"[ء-يٮ-ۓٱ]"
LATIN_LETTER_CLASS = "[A-Za-z]"
TOKEN_PATTERN = ARABIC_LETTER_CLASS + r"+|[A-Za-z]+|\p{Nd}+(?:[.,]\p{Nd}+)?"
MATCH_SEPARATORS = r"(?U)[\s\x1c-\x1f\-_/,،:;]+"

# What Python calls white space, for stripping.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0        "
    "        　"
)

# Characters NFKC never changes, alone or together; a text made only of these
# needs no normalisation pass.
NFKC_STABLE_CLASS = (
    r"\x00-\x7f¡-§©«-®°±¶·»¿-ÿ"
    r"؀-ْٖ-ٴٹ-ۿ–—‘-„•"
)

# --- fixed values: stop words -------------------------------------------------
ARABIC_STOPWORDS = [
    "في", "من", "على", "إلى", "الى", "عن", "أن", "ان", "إن", "ما", "هل", "هو", "هي",
    "مع", "كم", "ماذا", "متى", "أين", "اين", "كيف", "هذا", "هذه", "ذلك", "التي",
    "الذي", "و", "أو", "او", "ثم", "لا", "نعم", "قد", "كان", "يكون", "لدى", "لدي",
]
ENGLISH_STOPWORDS = [
    "the", "a", "an", "of", "in", "on", "at", "to", "for", "is", "are", "and", "or",
    "what", "how", "many", "much", "which", "do", "does", "i", "me", "my", "we", "with",
    "can", "there", "any", "be", "it", "this", "that",
]
ARABIC_ARTICLES = ["ال", "وال", "بال"]  # tried in this order, each on what the former left

# --- fixed values: dates ------------------------------------------------------
MONTHS_EN = [
    "January", "February", "March", "April", "May", "June", "July", "August",
    "September", "October", "November", "December",
]
MONTHS_AR = [
    "يناير", "فبراير", "مارس", "أبريل", "مايو", "يونيو", "يوليو", "أغسطس",
    "سبتمبر", "أكتوبر", "نوفمبر", "ديسمبر",
]
MONTHS_AR_PLAIN = {"ابريل": 4, "اغسطس": 8}
DATE_YEAR_FIRST = r"(?U)^(\d{4})-(\d{1,2})-(\d{1,2})"
DATE_DAY_FIRST = r"(?U)^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})"
DATE_DAY_MONTH_NAME = r"(?U)^(\d{1,2})\s+([^\s\d]+)\s+(\d{4})"
DATE_MONTH_NAME_DAY = r"(?U)^([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})"
DATE_ISO = r"\A\d{4}-\d{2}-\d{2}\z"
DATE_SUFFIX = "م"
MONTH_INDEX_BASE_YEAR = 2024

# --- fixed values: contract fields ---------------------------------------------
CONTRACT_FIELDS = [
    "contract_no", "contract_date", "buyer_name", "buyer_national_id", "buyer_phone",
    "project_name", "city", "unit_no", "unit_type", "area_sqm", "total_price_sar",
    "payment_method", "down_payment_sar", "installments_count", "installment_amount_sar",
    "bank_name", "delivery_date",
]
DECIMAL_FIELDS = ["area_sqm", "total_price_sar", "down_payment_sar", "installment_amount_sar"]
INTEGER_FIELDS = ["installments_count"]
DATE_FIELDS = ["contract_date", "delivery_date"]
ID_FIELDS = ["contract_no", "unit_no", "buyer_national_id", "buyer_phone"]
NAME_FIELDS = ["buyer_name", "project_name", "city"]
REQUIRED_FIELDS = ["contract_no", "buyer_name", "unit_no", "total_price_sar"]
TRUTH_LABELS = ["language", "template", "planted_issue"]

UNIT_TYPES = ["apartment", "townhouse", "duplex", "villa"]
UNIT_TYPE_ALIASES = {
    "شقة": "apartment", "شقه": "apartment", "apartment": "apartment", "flat": "apartment",
    "تاون هاوس": "townhouse", "تاونهاوس": "townhouse", "townhouse": "townhouse", "town house": "townhouse",
    "دوبلكس": "duplex", "duplex": "duplex",
    "فيلا": "villa", "فيلة": "villa", "villa": "villa",
}
PAYMENT_METHODS = ["installments", "bank_financing", "cash"]
PAYMENT_ALIASES = {
    "installments": "installments", "instalments": "installments", "أقساط": "installments", "اقساط": "installments",
    "bank_financing": "bank_financing", "bank financing": "bank_financing", "mortgage": "bank_financing",
    "تمويل بنكي": "bank_financing", "تمويل عقاري": "bank_financing", "تمويل": "bank_financing",
    "cash": "cash", "نقدي": "cash", "نقداً": "cash", "نقدا": "cash",
}
BANK_PLACEHOLDERS = ["", "null", "none", "n/a", "لا ينطبق", "-"]

# --- fixed values: contract layouts ----------------------------------------------
# One entry per clause: the pattern and the fields its groups fill.
CLAUSES_A = [
    (r"(?Ud)رقم العقد:\s*(\S+)", ["contract_no"]),
    (r"(?Ud)تاريخ العقد:\s*([\d/]+)", ["contract_date"]),
    (r"(?Ud)السيد/\s*(.+?)، هوية وطنية رقم (\d+)، جوال (\d+)", ["buyer_name", "buyer_national_id", "buyer_phone"]),
    (
        r"(?Ud)الوحدة رقم (\S+) من نوع (.+?) في مشروع (.+?) بمدينة (.+?)، بمساحة إجمالية قدرها ([\d.]+) متر",
        ["unit_no", "unit_type", "project_name", "city", "area_sqm"],
    ),
    (r"(?Ud)الثمن الإجمالي للوحدة هو ([\d,]+) ريال", ["total_price_sar"]),
    (r"(?Ud)موعد أقصاه ([\d/]+)", ["delivery_date"]),
]
CLAUSES_B = [
    (r"(?Ud)مرجع العقد:\s*(\S+)", ["contract_no"]),
    (r"(?Ud)إنه في يوم (\d{1,2} \S+ \d{4})", ["contract_date"]),
    (
        r"(?Ud)ثانياً:\s*(.+?)، (?:سعودي الجنسية|مقيم)، بموجب (?:الهوية|الإقامة) رقم (\d+)، هاتف (\d+)",
        ["buyer_name", "buyer_national_id", "buyer_phone"],
    ),
    (r"(?Ud)الكائن في (.+?)،", ["city"]),
    (
        r"(?Ud)يبيع المطور للمشتري (.+?) رقم (\S+) بمساحة ([\d.]+) م2 في مشروع (.+?)\.",
        ["unit_type", "unit_no", "area_sqm", "project_name"],
    ),
    (r"(?Ud)قيمة البيع الإجمالية ([\d,]+) ريال", ["total_price_sar"]),
    (r"(?Ud)موعد تسليم الوحدة:\s*(\d{1,2} \S+ \d{4})", ["delivery_date"]),
]
CLAUSES_D = [
    (r"(?Ud)Agreement No\.:\s*(\S+)", ["contract_no"]),
    (r"(?Udm)^Date:\s*(.+)$", ["contract_date"]),
    (
        r"(?Ud)Mr\./Ms\. (.+?), National ID No\. (\d+), Mobile (\d+)",
        ["buyer_name", "buyer_national_id", "buyer_phone"],
    ),
    (
        r"(?Ud)sells to the Purchaser (.+?) No\. (\S+) in the (.+?) project, (.+?), with a gross area of ([\d.]+)",
        ["unit_type", "unit_no", "project_name", "city", "area_sqm"],
    ),
    (r"(?Ud)total Purchase Price is SAR ([\d,]+)", ["total_price_sar"]),
    (r"(?Ud)no later than (\d{1,2} \w+ \d{4})", ["delivery_date"]),
]
# Payment clauses: the first one that matches decides the method.
PAYMENT_AR = [
    ("cash", r"(?Ud)كامل الثمن وقدره ([\d,]+) ريال"),
    (
        "bank_financing",
        r"(?Ud)دفعة مقدمة قدرها ([\d,]+) ريال عند التوقيع، ويُسدد المبلغ المتبقي وقدره ([\d,]+) ريال عن طريق التمويل العقاري من (.+?)\.",
    ),
    (
        "installments",
        r"(?Ud)دفعة مقدمة قدرها ([\d,]+) ريال عند التوقيع، ويُسدد المبلغ المتبقي على (\d+) أقساط متساوية قيمة كل قسط ([\d,]+) ريال",
    ),
]
PAYMENT_EN = [
    ("cash", r"(?Ud)full Purchase Price of SAR ([\d,]+) in cash"),
    (
        "bank_financing",
        r"(?Ud)down payment of SAR ([\d,]+) upon signing, and the balance of SAR ([\d,]+) through mortgage financing provided by (.+?)\.",
    ),
    (
        "installments",
        r"(?Ud)down payment of SAR ([\d,]+) upon signing, and the balance in (\d+) equal instalments of SAR ([\d,]+)",
    ),
]
# Key : value layout.
KEYED_FIELDS = {
    "رقم العقد": "contract_no", "تاريخ التوقيع": "contract_date", "اسم المشتري": "buyer_name",
    "رقم الهوية": "buyer_national_id", "رقم الجوال": "buyer_phone", "المشروع": "project",
    "رقم الوحدة": "unit_no", "نوع الوحدة": "unit_type", "المساحة": "area_sqm",
    "إجمالي الثمن": "total_price_sar", "طريقة السداد": "payment_method",
    "الدفعة المقدمة": "down_payment_sar", "عدد الأقساط": "installments_count",
    "قيمة القسط": "installment_amount_sar", "جهة التمويل": "bank_name", "تاريخ التسليم": "delivery_date",
}
KEYED_PROJECT_CITY_SEPARATOR = "–"
KEYED_CURRENCY = "ر.س"
KEYED_AREA_UNIT = "م²"

# --- fixed values: contract checks -----------------------------------------------
NATIONAL_ID_PATTERN = r"\A[12]\d{9}\z"
PHONE_PATTERN = r"\A(05\d{8}|\+9665\d{8})\z"
AREA_RANGE = (40, 2000)
CASH_TOLERANCE = 1.0
SUM_TOLERANCE_ABS = 1.0
SUM_TOLERANCE_REL = 0.001
MATCH_TOLERANCE_ABS = 0.5
MATCH_TOLERANCE_REL = 0.001
ISSUE_NATIONAL_ID = "national ID should be 10 digits starting with 1 (citizen) or 2 (resident)"
ISSUE_PHONE = "phone should be a Saudi mobile (05XXXXXXXX)"
ISSUE_PRICE = "total price must be positive"
ISSUE_AREA = "area outside plausible range (40–2000 sqm)"
ISSUE_CASH = "cash deal but down payment != total price"
ISSUE_SUM = "payments do not sum to price (expected %s, got %s)"
ISSUE_BANK = "bank financing without a bank name"
ISSUE_DATE = "%s is not a valid ISO date: %s"
ISSUE_ORDER = "delivery date precedes contract date"
ISSUE_MISSING = "missing required fields: "
ISSUE_FAILED = "extraction failed"

# --- fixed values: model replies --------------------------------------------------
FENCE_PATTERN = r"(?s)```(?:json)?\s*(.*?)```"

# --- fixed values: routing ----------------------------------------------------------
INVENTORY_HINTS_AR = [
    "كم عدد", "كم وحدة", "متاح", "متاحة", "المتاحة", "متوسط", "أقل سعر", "أرخص", "أغلى", "أعلى سعر",
    "مبيعات", "بيعت", "مباعة", "غرف", "مساحة", "الدور", "إطلالة", "أبيع", "بيع",
]
INVENTORY_HINTS_EN = [
    "how many", "available", "average", "cheapest", "most expensive", "sold", "sales", "bedroom", "sqm",
    "floor", "view", "list of", "units under", "price of unit", "which units",
]
DOCUMENT_HINTS_AR = [
    "رسوم", "سياسة", "ضمان", "ضريبة", "خطة السداد", "الدفعة", "إلغاء", "تسليم", "مرافق", "تمويل", "سكني",
    "وافي", "مستندات", "حجز", "خصم", "تواصل", "هاتف", "عن الشركة",
]
DOCUMENT_HINTS_EN = [
    "fee", "policy", "warranty", "tax", "payment plan", "instalment", "installment", "cancel", "handover",
    "amenit", "financ", "sakani", "wafi", "document", "booking", "discount", "contact", "phone",
    "about the company",
]
PROJECT_PATTERNS = {
    "NRJ": ["النرجس", "narjis"], "CST": ["الشاطئ", "coast"], "RWB": ["الروابي", "rawabi"],
    "YSM": ["الياسمين", "yasmin"], "KHM": ["الخبر", "khobar"], "AQQ": ["العقيق", "aqiq"],
}
PROJECT_CITIES = {
    "NRJ": "Riyadh", "YSM": "Riyadh", "CST": "Jeddah", "RWB": "Dammam", "KHM": "Al Khobar", "AQQ": "Madinah",
}
DEFAULT_CITY = "Riyadh"

# --- fixed values: prompt texts -------------------------------------------------------
EXCERPTS_HEAD = "DOCUMENT EXCERPTS:\n"
DATABASE_FAILED = ("DATABASE: the inventory query failed (", "). Say the figure is unavailable; do not guess.")
DATABASE_RESULT = ("DATABASE RESULT (SQL: ", "):\n")

# --- fixed values: SQL gate -----------------------------------------------------------
FORBIDDEN_SQL_WORDS = [
    "insert", "update", "delete", "drop", "alter", "create", "replace", "attach", "detach", "pragma",
    "vacuum", "reindex", "truncate", "grant", "revoke",
]
SQL_TOO_MANY = "multiple statements are not allowed"
SQL_NOT_SELECT = "only SELECT statements are allowed"
SQL_FORBIDDEN = "statement contains a forbidden keyword"

# --- fixed values: chunking and retrieval ------------------------------------------------
CHUNK_MAX_CHARS = 900
CHUNK_OVERLAP = 120
CHUNK_BREAKS = ["\n", ". ", "۔"]
VECTOR_DIM = 4096
NGRAM_RANGE = (3, 5)
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
RRF_K = 60
CANDIDATES = 25
TOP_K = 5
LANGUAGE_BOOST = 1.15
PROJECT_BOOST = 1.10
SHARED_PROJECT = "ALL"
HISTORY_TURNS = 6

# --- fixed values: forecasting and pricing --------------------------------------------------
DAMPED_ALPHA = 0.5
DAMPED_BETA = 0.2
DAMPED_PHI = 0.85
FORECAST_METHODS = ["naive_last", "mean_3", "damped_trend"]
MIN_MONTHLY_SALES = 0.05
PRICE_CATEGORICAL = ["project_id", "city", "unit_type", "view", "payment_method"]
PRICE_NUMERIC = ["bedrooms", "bathrooms", "area_sqm", "floor", "parking_spaces", "month_index"]
GBT_ITERATIONS = 400
GBT_STEP = 0.05
GBT_LEAVES = 15
GBT_MIN_LEAF = 10
IMPORTANCE_REPEATS = 5
MIN_TEST_ROWS = 20
DEFAULT_PAYMENT = "bank_financing"

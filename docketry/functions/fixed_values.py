"""The word lists, labels and formats that results depend on. Their order is part of the rules."""

# Phrases that ask for something, by category.
ACTION_GROUPS = {
    "expiry": ("expire", "expires", "expiry", "expiration", "valid until", "valid till", "valid upto", "valid through", "good through", "lapses"),
    "renewal": ("renew", "renews", "renewal", "auto-renew", "subscription", "membership", "recurring"),
    "cancellation": ("cancel", "cancellation", "opt out", "notice period", "terminate", "termination", "surrender"),
    "money": ("pay", "payment", "premium", "balance", "fee", "deposit", "refund", "amount due", "net pay", "total amount", "emi"),
    "submission": ("submit", "submission", "apply", "application", "file by", "respond", "response", "file tax", "filing due"),
    "appointment": ("appointment", "meeting", "hearing", "interview", "visit", "check-in", "consultation"),
    "delivery": ("deliver", "delivery", "ship", "return by", "complete", "milestone", "launch", "dispatch"),
    "warranty": ("warranty", "guarantee", "coverage", "trial", "return window", "applecare", "amc"),
    "taxes": ("tax return", "file tax", "irs filing", "1099", "w2", "w-2", "form 16", "itr", "advance tax", "tds", "gst filing", "quarterly estimate"),
    "housing": ("lease end", "lease expiry", "rent due", "rental renewal", "deposit refund", "society maintenance"),
    "utilities": ("electricity due", "energy bill", "utility payment", "broadband contract", "water bill due"),
    "banking": ("statement balance", "minimum payment", "credit card payment", "loan due", "cd maturity", "fd maturity", "emi due", "payment due date"),
    "legal": ("termination date", "nda expiry", "compliance deadline", "statute", "agreement expires"),
    "vehicle": ("vehicle registration", "registration renewal", "smog check", "mot due", "puc expiry", "fitness certificate"),
    "travel": ("passport expiry", "visa expiry", "global entry", "tsa precheck", "departure date", "valid visa"),
    "employment": ("probation end", "benefits enrollment", "fsa deadline", "hsa deadline", "salary credit", "appraisal date", "increment date"),
    "billing": ("invoice due", "remittance due", "net 30", "net-30", "payable by", "tax invoice due"),
}

# Further phrases that make a date a deadline.
DEADLINE_WORDS = (
    "due", "deadline", "before", "by", "no later than", "remind", "schedule", "book",
    "pay", "expires", "renew", "valid until", "valid upto", "payable", "must be received",
    "last date", "last day", "maturity date", "due date", "payment due", "filing due",
    "credit date", "period ending", "as of",
)

# Categories that compete when the document's domain is known.
DOMAIN_FREE_CATEGORIES = ("expiry", "renewal", "cancellation", "money", "submission", "appointment", "delivery", "warranty")

# Phrases that make a date a record of the past.
HISTORICAL_WORDS = (
    "issued on", "created on", "updated on", "published on", "founded on", "born on", "purchased on",
    "transaction date", "invoice date", "statement date", "statement period", "bill date", "effective from", "copyright", "version",
    "changelog", "minutes from", "attended", "completed on", "paid on", "sent on", "received on",
)
INFORMATION_WORDS = (
    "printed on", "generated on", "last modified", "last updated", "release date",
    "publication date", "date of birth", "birth date", "effective date", "start date", "opening date",
)

# Labels of date fields.
MILESTONE_FIELDS = (
    "expiry date", "expiration date", "renewal date", "premium due date", "payment due date",
    "due date", "coverage end", "coverage ends", "policy end date", "termination date",
    "maturity date", "valid until", "valid till", "valid through", "last date", "respond by",
)

# What the document is about, first rule that applies.
ENTITY_HINTS = (
    (("form 16", "form 16a", "itr", "itr-v", "income tax return", "advance tax", "tds return", "gstin", "1099-misc", "w-2 form", "form 1040"), "Tax Filing"),
    (("bank statement", "account statement", "hdfc bank", "icici bank", "state bank of india", "axis bank", "kotak bank", "chase bank", "citibank", "bank of america", "barclays"), "Bank Statement"),
    (("salary slip", "payslip", "pay stub", "wage slip", "earnings statement"), "Salary Slip"),
    (("health insurance", "medical insurance", "health policy", "new india assurance", "star health", "hdfc ergo", "care health"), "Health Insurance"),
    (("motor insurance", "vehicle insurance", "car insurance", "auto insurance"), "Vehicle Insurance"),
    (("life insurance", "term life", "lic policy", "max life"), "Life Insurance"),
    (("travel insurance",), "Travel Insurance"),
    (("home insurance", "property insurance"), "Home Insurance"),
    (("lease agreement", "rental agreement", "lease deed", "tenancy agreement"), "Lease"),
    (("fixed deposit", "fd advice", "recurring deposit"), "Fixed Deposit"),
    (("loan agreement", "home loan", "personal loan", "car loan", "mortgage loan", "emi statement"), "Loan Agreement"),
    (("credit card statement", "credit card payment"), "Credit Card"),
    (("mobile number", "mobile bill", "sim card", "prepaid mobile", "postpaid plan", "airtel broadband", "jio fiber"), "SIM Plan"),
    (("energy plan", "electricity bill", "gas plan", "power bill", "water bill"), "Energy Plan"),
    (("passport", "passport renewal"), "Passport"),
    (("travel visa", "e-visa", "visa application"), "Travel Visa"),
    (("driver licence", "driver's licence", "driving license"), "Driver’s Licence"),
    (("vehicle registration", "rc book", "puc certificate"), "Vehicle Registration"),
    (("subscription renewal", "saas membership", "annual membership"), "Subscription"),
    (("warranty certificate", "applecare", "extended warranty"), "Warranty"),
    (("certification", "professional license"), "Certification"),
    (("contract", "nda agreement", "service agreement"), "Agreement"),
    (("tax invoice", "commercial invoice", "invoice due"), "Invoice"),
    (("appointment", "doctor consultation"), "Appointment"),
    (("visa application", "job application"), "Application"),
    (("delivery shipment", "package delivery"), "Delivery"),
)

# Titles of statements, of categories and of domains.
STATEMENT_TITLE = "Bank Account Statement"
CATEGORY_TITLES = {
    "expiry": "Expiry",
    "renewal": "Renewal",
    "cancellation": "Cancellation Deadline",
    "money": "Payment Due",
    "submission": "Submission Deadline",
    "appointment": "Appointment",
    "delivery": "Delivery Due",
    "warranty": "Coverage Ends",
    "taxes": "Tax Deadline / Filing",
    "housing": "Lease Milestone",
    "insurance": "Insurance Policy Renewal",
    "subscription": "Subscription Renewal",
    "utilities": "Utility Bill Due",
    "banking": "Statement / Payment Due",
    "legal": "Legal / Contract Deadline",
    "vehicle": "Vehicle Milestone",
    "travel": "Passport / Travel Expiry",
    "employment": "Payroll / Employment Notice",
    "billing": "Invoice Due",
    "action": "Action Due",
}
DOMAIN_LABELS = {
    "taxes": "Tax Filing / Return",
    "housing": "Lease / Rent",
    "insurance": "Insurance Policy",
    "subscription": "Subscription",
    "utilities": "Utility Bill",
    "banking": "Bank Account Statement",
    "warranty": "Warranty",
    "legal": "Agreement",
    "vehicle": "Vehicle Milestone",
    "travel": "Travel / Passport",
    "employment": "Salary Slip / Payslip",
    "billing": "Invoice",
}
DEFAULT_LABEL = "Document"

# Markers tested on a line.
EXAMPLE_MARKERS = ("example", "for example", "for instance", "sample", "suppose", "imagine", "exercise", "tutorial", "case study", "hypothetical", "demo", "illustration")
OVERDUE_MARKERS = ("overdue", "past due", "remains due", "still due", "unpaid", "outstanding", "action required")
OVERRIDE_MARKERS = ("due", "expires", "valid", "renew", "filing", "maturity", "pay")
RANGE_MARKERS = ("period of insurance", "coverage period", "policy period", "valid from", "effective from", "from ", "between ", "start date", "commencement date", "for period", "statement period")
RANGE_SEPARATORS = (" to ", " through ", " until ", " - ")

# Domains and their terms.
DOMAIN_TERMS = {
    "taxes": ("income tax return", "assessment year", "tax payable", "itr-v", "form 16", "form 26as", "advance tax", "gstin", "tax filing", "irs filing", "form 1040", "taxpayer", "tax period", "filing period", "due date"),
    "housing": ("lease agreement", "rental agreement", "tenancy agreement", "rent due", "lease renewal", "security deposit", "landlord", "tenant", "lease term", "commencement date", "expiration date"),
    "insurance": (
        "insurance policy", "policyholder", "policy number", "insurance premium", "coverage period", "sum insured", "policy renewal", "insurance claim",
        "health insurance", "motor insurance", "life insurance", "period of insurance", "policy schedule", "insured name", "name of insured", "premium due",
        "renewal premium", "policy expiry", "policy end date", "coverage ends", "certificate of insurance", "insurer",
    ),
    "subscription": ("subscription renewal", "membership renewal", "auto-renew", "billing period", "monthly subscription", "annual membership", "renewal date", "next billing date"),
    "utilities": ("electricity bill", "power bill", "water bill", "gas bill", "broadband bill", "mobile postpaid", "utility bill", "payment due date", "billing period", "consumer number", "meter number"),
    "banking": (
        "bank statement", "account statement", "statement of account", "statement period", "statement of transactions", "transaction statement", "account number", "account no",
        "opening balance", "closing balance", "transaction date", "value date", "withdrawal", "deposit", "debit", "credit", "available balance",
    ),
    "warranty": ("warranty certificate", "warranty coverage", "extended warranty", "return window", "replacement guarantee", "service warranty", "warranty period", "coverage end date"),
    "legal": ("non-disclosure agreement", "employment contract", "service agreement", "termination notice", "notice period", "governing law", "effective date", "term of agreement", "expiration date", "renewal term"),
    "vehicle": ("vehicle registration", "registration certificate", "driving licence", "driver licence", "puc certificate", "fitness certificate", "road tax", "registration expiry", "validity date"),
    "travel": ("passport expiry", "passport renewal", "passport", "visa expiry", "travel visa", "flight itinerary", "departure date"),
    "employment": ("salary slip", "pay slip", "payslip", "pay stub", "earnings statement", "net pay", "gross salary", "offer letter", "notice period", "pay period", "salary credit date", "joining date"),
    "billing": ("invoice due", "tax invoice", "amount due", "balance due", "payment terms", "remittance advice", "net 30", "payable by", "invoice"),
}

# Terms of the relevance gate.
ACTION_TERMS = (
    "due", "deadline", "expires", "expiry", "expiration", "valid until", "valid till",
    "valid through", "renew", "renews", "renewed", "renewal", "cancel by", "cancellation", "terminate by",
    "pay by", "payment due", "submit by", "return by", "coverage ends", "file by",
    "filing due", "maturity date", "action required", "notice must", "respond by",
    "expiry date", "expiration date", "renewal date", "due date", "coverage end date",
    "policy end date", "registration expiry", "validity date",
)
REFERENCE_MARKERS = (
    "for beginners", "programming essentials", "textbook", "e-book", "ebook", "tutorial",
    "course material", "learning objectives", "chapter summary", "practice exercise",
    "sample code", "source code", "table of contents", "isbn", "publisher",
)
CODE_TOKENS = (" def ", " class ", " import ", "print(", "python ", "javascript ")
STATEMENT_NAMES = ("bank statement", "account statement", "statement of account", "statement period", "statement of transactions", "transaction statement", "account number", "account no")
BALANCE_NAMES = ("opening balance", "closing balance", "available balance")
BANK_HEADERS = ("date", "description", "particulars", "narration", "transaction", "withdrawal", "deposit", "debit", "credit", "amount", "balance")
SAMPLE_TOKENS = 1200

# Spending categories by keyword, first that applies.
SPENDING = {
    "Salary & Income": ("salary", "payroll", "wage", "stipend", "bonus", "dividend", "interest credit", "direct dep", "neft cr", "ach credit"),
    "Rent & Housing": ("rent", "landlord", "society maint", "maintenance fee", "hoa dues", "property tax"),
    "Utilities & Bills": ("electricity", "power", "water board", "gas bill", "broadband", "fiber", "airtel", "jio", "verizon", "utility", "billdesk"),
    "Subscriptions": ("netflix", "spotify", "apple.com", "prime", "youtube", "github", "google one", "hotstar", "adobe", "icloud", "dropbox"),
    "Food & Groceries": ("swiggy", "zomato", "blinkit", "zepto", "instamart", "uber eats", "doordash", "supermarket", "grocery", "restaurant", "cafe"),
    "Shopping": ("amazon", "flipkart", "myntra", "target", "walmart", "apple store", "paypal", "ebay", "retail", "pos purchase"),
    "Travel & Commute": ("uber", "ola", "lyft", "flight", "airline", "irctc", "railway", "petrol", "fuel", "shell", "metro", "toll", "fastag", "parking"),
    "Investments & Savings": ("zerodha", "groww", "vanguard", "fidelity", "mutual fund", "sip", "fixed deposit", "stock", "equity", "crypto", "rd debit"),
    "EMI & Loans": ("emi", "loan repayment", "home loan", "car loan", "mortgage", "credit card payment"),
}
INCOME, OTHER_SPENDING = "Salary & Income", "Other Expenses"

# Names of statement columns.
HEADER_ALIASES = {
    "date": ("date", "transaction date", "txn date", "value date", "posting date"),
    "description": ("description", "particulars", "narration", "transaction details", "details", "memo"),
    "debit": ("debit", "debit amount", "withdrawal", "withdrawal amount", "withdrawal amt", "withdrawals", "money out", "paid out", "dr amount"),
    "credit": ("credit", "credit amount", "deposit", "deposit amount", "deposit amt", "deposits", "money in", "paid in", "cr amount"),
    "amount": ("amount", "transaction amount", "txn amount"),
    "type": ("type", "cr/dr", "dr/cr", "transaction type"),
    "balance": ("balance", "running balance", "closing balance"),
}

# Words that do not tell payees apart.
PAYEE_NOISE = ("upi", "pos", "card", "payment", "transfer", "debit", "txn", "ref")

# File policy.
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".webp", ".tiff")
DOCUMENT_EXTENSIONS = (".pdf", ".docx", ".pages", ".eml", ".msg", ".csv", ".xlsx")
IGNORED_DIRECTORIES = (
    ".git", ".svn", ".hg", "venv", ".venv", "env", "site-packages",
    "__pycache__", "node_modules", "bower_components", "build", "dist",
    "target", "out", "bin", "obj", "library", "appdata", "tmp", ".cache",
)
MAX_FILE_BYTES = 8 * 1024 * 1024
# Seconds that reading a file may take, and what is said of one that takes longer.
READER_SECONDS, TOO_SLOW = 60, "reader exceeded the {} second safety limit"
# Most files and bytes of an upload batch, and files of a listing's chunk.
UPLOAD_FILES, UPLOAD_BYTES, CHUNK_FILES = 6, 7 * 512 * 1024, 400
MAX_ENTRY_BYTES, BOMB_BYTES, BOMB_RATIO = 32 * 1024 * 1024, 1024 * 1024, 200

# Reasons for leaving something out.
UNSUPPORTED_FILE, IGNORED_DIRECTORY, IRRELEVANT, NO_ACTION, HISTORICAL, DUPLICATE, REFERENCE = (
    "unsupported_file_type", "ignored_directory", "irrelevant_document", "no_actionable_commitment", "historical_noise", "duplicate_commitment", "reference_example",
)

# Months, and the patterns of dates in a text, in the order in which they are tried.
_EDGE = r"(?U:\b)"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MONTH_NAMES = {m: i for i, m in enumerate(MONTHS, 1)} | {m[:3]: i for i, m in enumerate(MONTHS, 1)}
_MONTH = "|".join(sorted(MONTH_NAMES, key=len, reverse=True))
_DAY_NUMBER, _MONTH_NUMBER = "0?[1-9]|[12][0-9]|3[01]", "0?[1-9]|1[0-2]"

ISO = rf"{_EDGE}(20[0-9]{{2}})[-/.]({_MONTH_NUMBER})[-/.]({_DAY_NUMBER}){_EDGE}"
MONTH_DAY = rf"(?i){_EDGE}({_MONTH})\.?(?U:\s+)([0-9]{{1,2}})(?:st|nd|rd|th)?(?:,?(?U:\s+)(20[0-9]{{2}}))?{_EDGE}"
DAY_MONTH = rf"(?i){_EDGE}([0-9]{{1,2}})(?:st|nd|rd|th)?(?:(?U:[\s\-/]+)(?:of(?U:\s+))?)({_MONTH})\.?(?:(?U:[\s\-/]+)(20[0-9]{{2}}))?{_EDGE}"
NUMERIC = rf"(?<![0-9/.-])({_DAY_NUMBER})[/.-]({_DAY_NUMBER})[/.-](20[0-9]{{2}})(?![0-9])"
RELATIVE = rf"(?i){_EDGE}(?:in|within|before|by|due(?U:\s+)in)(?U:\s+)([0-9]{{1,3}})(?U:\s+)(business(?U:\s+))?(day|week|month)s?{_EDGE}"
TODAY, TOMORROW = rf"(?i){_EDGE}today{_EDGE}", rf"(?i){_EDGE}tomorrow{_EDGE}"
MOST_UNITS = 730

# What shows that a document has a date, and a row of a statement.
HAS_DATE = (
    r"(?i)(?U:\b)(?:20[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.]20[0-9]{2}|"
    r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)(?U:\s+)[0-9]{1,2})(?U:\b)"
)
DATED_ROW = r"(?m)^(?U:\s*)[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}.*[0-9][0-9,]*(?:\.[0-9]{2})"

# How often something recurs, how long before it notice is due, and rows of a statement within a document.
PERIODICITY = r"(?i)(?U:\b)(monthly|per(?U:\s+)month|/mo|p\.m\.|annually|per(?U:\s+)annum|annual|/yr|p\.a\.|per(?U:\s+)year|quarterly|one-time|one(?U:\s+)time|per(?U:\s+)period)(?U:\b)"
NOTICE = r"(?i)(?:at(?U:\s+)least|within|requires?|give|prior(?U:\s+)to|notice(?U:\s+)of)?(?U:\s*)([0-9]{1,3})(?U:\s*)(?:business(?U:\s+))?(day|week|month)s?(?U:\s*)(?:prior|before|advance|notice)"
STATEMENT_ROW = r"^\s*(?:[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4}|20[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2})"

# What is in every line that has a date of its own, of any shape that statements' dates have, between marks that may part cells.
_CELL_EDGE = r"[|\t,\"]|(?U:\s){2}"
DATED_CELL = rf"(?i)(?:^|{_CELL_EDGE})(?U:\s*)(?:[0-9]{{1,4}}[-/.][0-9]{{1,2}}[-/.][0-9]{{1,4}}|[0-9]{{1,2}}(?U:\s+)[a-z]{{3}}(?U:\s+)[0-9]{{2,4}}|[0-9]{{5}}(?:\.0+)?)(?U:\s*)(?:$|{_CELL_EDGE})"

# Marks of credits and debits in rows without a header.
FLAG = r"(?i)^(?:CR|DR|CREDIT|DEBIT)$"
FLAGGED = r"(?i)^(?U:\s*)([^A-Za-z]*[0-9][^A-Za-z]*)(?U:\s*)(CR|DR|CREDIT|DEBIT)(?U:\s*)$"

# Currencies before an amount, and what tells a text's currency, in the order in which it is tried.
CURRENCY_MARKS = r"₹|Rs\.?|INR|\$|USD|€|EUR|£|GBP"
CURRENCIES = ((r"inr|₹|rs\.|hdfc|icici|sbi bank|axis bank", "₹"), ("€|eur", "€"), ("£|gbp", "£"), (r"\$|usd", "$"))

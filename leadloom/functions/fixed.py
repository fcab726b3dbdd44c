"""Word lists, lookup tables, constants and text patterns.

Everything in this module is a fixed value that must equal what existing users
of these rules rely on.  Lists are plain text in their natural order; order is
significant wherever "first match wins".
"""

from __future__ import annotations

# --- record layout ---------------------------------------------------------

RAW_FIELDS = [
    "company_name", "website", "phone", "email", "address", "city", "state", "country", "industry", "industry_type",
    "description", "additional_info", "source", "employee_count", "branch_count", "turnover", "contact_name",
    "erp_software",
]
EXTRA_FIELDS = ["owner_role", "pincode", "source_url", "decision_maker"]

# output column name -> record field ("" = serial number)
OUTPUT_COLUMNS = [
    ("SL No.", ""),
    ("Company Name", "company_name"),
    ("Website", "website"),
    ("Owner/ IT Head/ CEO/Finance Head Name", "contact_name"),
    ("Phone Number", "phone"),
    ("EMail Address", "email"),
    ("Address", "address"),
    ("City", "city"),
    ("State", "state"),
    ("Country", "country"),
    ("Industry_Type", "industry_type"),
    ("Employee_No", "employee_count"),
    ("Branch/Warehouse_No", "branch_count"),
    ("Annual_Turnover", "turnover"),
    ("Current_Use_ERP_Software_Name", "erp_software"),
    ("Description", "description"),
    ("Source", "source"),
    ("Additional_Information", "additional_info"),
]

# fields a merge fills from later records; the others stay with the first record
MERGE_FIELDS = [
    "company_name", "website", "email", "phone", "address", "city", "state", "country", "industry", "industry_type",
    "description", "source",
]

MIN_QUALITY = "5.5"
SIMILAR_PERCENT = 85

# --- text ------------------------------------------------------------------

LOREM = [
    "lorem ipsum", "dolor sit amet", "consectetur adipiscing elit", "sed do eiusmod", "tempor incididunt",
    "labore et dolore magna",
]

# --- e-mail ----------------------------------------------------------------

EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
EMAIL_TLDS = [
    "com", "org", "net", "edu", "gov", "co", "uk", "io", "ai", "app", "dev", "info", "biz", "pro", "me", "us", "ca",
    "au", "de", "fr", "jp", "cn", "in", "nl", "es", "it", "br", "mx", "ru", "ch", "at", "be", "se", "no", "dk", "fi",
    "pl", "pt", "ie", "nz", "sg", "hk", "kr", "za", "ae", "ph", "my", "th", "vn", "id", "eg", "pk", "bd", "lk", "np",
    "mm", "kh", "ir", "iq", "sa", "qa", "kw", "bh", "om", "jo", "lb", "sy", "ps", "il", "tr", "ua", "by", "kz", "uz",
    "az", "ge", "am", "mn",
]
DISPOSABLE_DOMAINS = [
    "tempmail.com", "guerrillamail.com", "mailinator.com", "throwaway.com", "fakeinbox.com", "10minutemail.com",
    "temp-mail.org", "yopmail.com", "trashmail.com", "dispostable.com", "maildrop.cc", "getairmail.com",
    "mailnesia.com", "spamgourmet.com", "mintemail.com", "sharklasers.com", "guerrillamailblock.com", "pokemail.net",
    "spambox.us", "mailcatch.com", "spamex.com", "emailwarden.com", "throwawaymail.com", "tempinbox.com",
    "getnada.com", "mohmal.com", "guerrillamail.org", "guerrillamail.net", "guerrillamail.biz", "guerrillamail.de",
    "grr.la", "mailforspam.com",
]
NO_REPLY_PREFIXES = ["noreply", "no-reply", "donotreply"]
SUSPICIOUS_EMAIL_PARTS = [
    "example.com", "test.com", "localhost", "127.0.0.1", "domain.com", "sample.com", "dummy.com", "fake.com",
]
FREE_MAIL_NAMES = [
    "gmail", "yahoo", "hotmail", "outlook", "aol", "icloud", "live", "msn", "ymail", "mail", "protonmail", "zoho",
    "rediffmail", "indiatimes", "sify", "eth.net",
]

# --- phone -----------------------------------------------------------------

PHONE_PATTERNS = [
    r"(?:\+91[\s\-]?)?([6-9]\d{9})",
    r"(?:[\+]?91[\s\-]?)?(?:0?[\s\-]?)?(\d{2,5})[\s\-]?\d{6,8}",
    r"(?:\+?1[\s\-.]?)?(?:\(?\d{3}\)?[\s\-.]?)?\d{3}[\s\-.]?\d{4}",
    r"(?:\+?44[\s\-.]?)?(?:0[\s\-.]?)?\d{4}[\s\-.]?\d{6}",
    r"(?:\+?\d{1,4}[\s\-.]?)?\(?\d{1,4}\)?[\s\-.]?\d{1,4}[\s\-.]?\d{1,9}",
]
FAKE_PHONES = [
    "0000000000", "1111111111", "2222222222", "3333333333", "4444444444", "5555555555", "6666666666", "7777777777",
    "8888888888", "9999999999", "1234567890", "0123456789", "9876543210", "0987654321", "1111111111111",
    "0000000000000",
]
LOOSE_PHONE_PATTERNS = [
    r"(?:\+91[\s\-]?)?[6-9]\d{9}",
    r"\b\d{10}\b",
    r"\b\d{3}[\s\-]\d{3}[\s\-]\d{4}\b",
    r"\(\d{3}\)\s?\d{3}[\s\-]\d{4}",
]
SUMMARY_PHONE_PATTERN = r"\+?\d[\d\s\-]{8,}\d"

# --- company names ---------------------------------------------------------

LEGAL_SUFFIXES = [
    "private limited", "pvt ltd", "pvt. ltd.", "private ltd", "limited", "ltd", "ltd.", "llp", "inc", "inc.",
    "incorporated", "corporation", "corp", "corp.", "co", "co.", "company", "group", "holdings", "enterprises",
    "services", "solutions", "industries", "international", "global", "technologies", "systems", "consultancy",
    "consulting", "manufacturers", "traders", "exporters", "importers", "agency", "associates", "partners",
    "ventures", "pvt", "public limited", "public ltd",
]
INVALID_NAME_PATTERNS = [
    r"^undefined$", r"^null$", r"^none$", r"^na$", r"^n/a$", r"^test", r"^demo", r"^sample", r"^example",
    r"click here", r"read more", r"learn more", r"sign in", r"sign up", r"log in", r"log out", r"register",
    r"subscribe", r"newsletter", r"©?\s*\d{4}", r"^\d+$", r"^\s*$", r"http", r"www\.", r"\.com", r"\.org", r"\.net",
    r"home", r"about", r"contact", r"products", r"services", r"menu", r"search", r"cart", r"checkout", r"login",
    r"signup", r"forgot", r"privacy", r"terms", r"policy", r"^\s*[-–—]\s*$", r"^\s*\|\s*$",
]
JUNK_NAMES = [
    "undefined", "null", "none", "test company", "sample company", "click here", "read more", "learn more",
]
TITLE_NOISE = [
    r"\s*[-|–—]\s*.+$", r"\s*::\s*.+$", r"\s*»\s*.+$", r"\bHome\b.*$", r"\bWelcome\b.*$", r"\bOfficial\b.*$",
]
COPYRIGHT_NAME = r"©\s*(?:\d{4})?\s*([A-Z][A-Za-z0-9\s&.,()-]{2,60}?)(?:Pvt|Ltd|Private|All Rights|\.)"
ORGANIZATION_TYPES = ["Organization", "LocalBusiness", "Corporation"]
LINE_STOP_WORDS = ["contact", "email", "phone", "address", "copyright"]
NAME_NOISE = r"\b(Home|Welcome|Index|Official|Website|Online|Portal)\b"

# --- pages -----------------------------------------------------------------

ADDRESS_PATTERN = (
    r"\b\d+[\w\-,./ ]{5,}(street|st\.|road|rd\.|avenue|ave\.|boulevard|blvd\.|lane|ln\.|sector|suite|floor|"
    r"industrial area|park|city|state|zip|postal)\b"
)
ADDRESS_CLASS_WORDS = ["address", "location", "contact"]
ROLE_KEYWORDS = [
    "ceo", "founder", "co-founder", "cto", "cfo", "director", "head of it", "it head", "finance head",
    "chief technology officer", "chief financial officer", "managing director",
]
PERSON_PATTERN = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})"
PROFILE_LINK_BLOCKLIST = ["google.", "linkedin.com", "indiamart.com", "tradeindia.com", "justdial.com"]
CAPTCHA_MARKERS = ["bots use DuckDuckGo", "Select all squares"]
ENTITY_PATTERNS = {
    "EMAIL": r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+",
    "PHONE": r"(?:\+?\d{1,3}[\s-]?)?(?:\(?\d{2,4}\)?[\s-]?)?\d{3,4}[\s-]?\d{3,4}",
    "REVENUE": r"(?i)(?:₹|\$|€|£|Rs\.?|INR|USD)?\s*[\d,.]+\s*(?:Cr|Crore|Million|Billion|Lakh)\b",
    "ERP": r"(?i)\b(SAP|Oracle|Odoo|Dynamics|NetSuite|Tally|Zoho|Salesforce)\b",
    "EMPLOYEES": r"(?i)(\d{1,6}\s*(?:\+|employees)|\d{1,6}\s*-\s*\d{1,6}\s*employees)",
    "LEADERSHIP_ROLE": r"(?i)\b(?:CEO|CFO|CTO|Director|Founder|VP|President|Head)\b",
}
LABEL_TEMPLATES = [
    "We are {COMPANY}, located at {ADDRESS}. You can reach our CEO {PERSON} at {PHONE} or {EMAIL}.",
    "The company {COMPANY} operates in the {INDUSTRY} sector.",
    "{PERSON} is the head of {COMPANY}, making around {REVENUE} annually.",
    "Contact {PERSON} via email at {EMAIL} or call {PHONE}.",
    "{COMPANY} is a major player in {INDUSTRY} with an estimated {REVENUE} turnover. They use {ERP}.",
]
LABEL_MISSING = ["", "Not publicly documented", "Not publicly disclosed"]

# --- industries ------------------------------------------------------------

INDUSTRY_NAMES = {
    "it services": "IT Services", "it service": "IT Services", "information technology": "IT Services",
    "software": "Software", "software development": "Software Development", "software services": "Software Services",
    "manufacturing": "Manufacturing", "retail": "Retail", "ecommerce": "E-Commerce", "e-commerce": "E-Commerce",
    "logistics": "Logistics", "transportation": "Transportation", "healthcare": "Healthcare",
    "education": "Education", "finance": "Finance", "banking": "Banking", "insurance": "Insurance",
    "real estate": "Real Estate", "realestate": "Real Estate", "construction": "Construction",
    "automotive": "Automotive", "food & beverage": "Food & Beverage", "food and beverage": "Food & Beverage",
    "telecommunications": "Telecommunications", "media": "Media", "entertainment": "Entertainment",
    "hospitality": "Hospitality", "energy": "Energy", "mining": "Mining", "agriculture": "Agriculture",
    "pharmaceuticals": "Pharmaceuticals", "textiles": "Textiles", "chemicals": "Chemicals", "machinery": "Machinery",
    "electronics": "Electronics",
}
INDUSTRY_KEYWORDS = {
    "Manufacturing": ["manufacturer", "manufacturing", "factory", "industrial", "production"],
    "Retail": ["retail", "ecommerce", "store", "shop"],
    "Logistics": ["logistics", "warehouse", "supply chain", "freight", "transport"],
    "Healthcare": ["healthcare", "medical", "hospital", "pharma", "pharmaceutical"],
    "Technology": ["software", "saas", "technology", "it services", "digital", "tech"],
    "Furniture": ["furniture", "interior", "home decor"],
    "Food & Beverage": ["food", "beverage", "biscuits", "snacks", "bakery", "oil"],
    "Mining": ["mica", "mining", "minerals"],
    "Education": ["education", "school", "college", "university", "training"],
    "Finance": ["finance", "banking", "insurance", "investment"],
    "Real Estate": ["real estate", "property", "construction", "building"],
    "Automotive": ["automotive", "vehicle", "car", "transportation"],
    "Agriculture": ["agriculture", "farming", "organic", "seeds"],
    "Chemicals": ["chemical", "chemicals", "solvents", "polymers"],
    "Textiles": ["textile", "textiles", "fabric", "yarn", "garments"],
    "Oil & Gas": ["oil", "gas", "petroleum", "lubricant", "fuel"],
}
PLACE_TYPE_INDUSTRY = {
    "restaurant": "Food & Beverage", "food": "Food & Beverage", "store": "Retail", "health": "Healthcare",
    "hospital": "Healthcare", "doctor": "Healthcare", "school": "Education", "university": "Education",
    "real_estate_agency": "Real Estate", "lawyer": "Legal Services", "accounting": "Finance",
    "bank": "Banking & Finance", "insurance_agency": "Insurance", "car_dealer": "Automotive",
    "lodging": "Hospitality", "hotel": "Hospitality", "gym": "Fitness & Wellness", "spa": "Beauty & Wellness",
    "travel_agency": "Travel", "it_company": "Information Technology", "software": "Information Technology",
    "manufacturer": "Manufacturing", "logistics": "Logistics", "construction": "Construction",
}

# --- company facts ---------------------------------------------------------

EMPLOYEE_PATTERNS = [
    r"(\d[\d,]*)\s*\+?\s*employees",
    r"team\s+of\s+(?:over\s+)?(\d[\d,]*)",
    r"workforce\s+of\s+(?:over\s+)?(\d[\d,]*)",
    r"(\d[\d,]*)\s*\+?\s*professionals",
    r"over\s+(\d[\d,]*)\s+(?:people|staff|employees)",
    r"(\d[\d,]*)\s*[-–]\s*strong\s+team",
    r"employs?\s+(?:over\s+)?(\d[\d,]*)",
    r"(\d[\d,]*)\s*\+?\s*(?:member|associate|colleague)s?",
]
EMPLOYEE_BANDS = [(10, "1-10"), (50, "11-50"), (200, "51-200"), (500, "201-500"), (1000, "501-1000")]
EMPLOYEE_TOP_BAND = "1000+"
MAX_EMPLOYEES = 500000
TURNOVER_PATTERNS = [
    r"(?:annual\s+)?(?:turnover|revenue|sales)\s*:?\s*(?:Rs\.?|₹|INR)?\s*([\d,.]+)\s*(crore|cr|lakh|million|billion)",
    r"(?:Rs\.?|₹)\s*([\d,.]+)\s*(cr(?:ore)?)",
]
BRANCH_PATTERNS = [
    r"(\d+)\s*(?:branches|branch|warehouses|warehouse|locations|location|offices|office|stores|store)",
    r"(?:operates?\s+(?:in|from)\s+)?(\d+)\s+(?:cities|locations|markets?)",
]
CONTACT_PATTERNS = [
    r"(?:ceo|chief executive)\s*(?:officer)?[:\s]+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})",
    r"(?:director|md|managing director)[:\s]+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})",
    r"(?:founder|proprietor|owner)[:\s]+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})",
]
ERP_PATTERNS = [
    ("SAP", r"\bSAP\b"),
    ("Oracle", r"\bOracle\b"),
    ("Tally", r"\bTally(?:Prime|ERP)?\b"),
    ("Zoho", r"\bZoho\s*(?:Books|CRM|ERP)?\b"),
    ("Odoo", r"\bOdoo\b"),
    ("Infor", r"\bInfor\b"),
    ("Microsoft Dynamics", r"\bDynamics\s*365\b|\bDynamics\s*AX\b"),
    ("Busy", r"\bBUSY\s*(?:Software|Accounting)?\b"),
    ("Marg ERP", r"\bMARG\s*ERP\b"),
]
ERP_PHRASES = [
    ("SAP", [" sap ", "sap s/4hana", "sap business one"]),
    ("Oracle ERP", ["oracle erp", "oracle fusion"]),
    ("Microsoft Dynamics", ["microsoft dynamics", "dynamics 365", "d365"]),
    ("NetSuite", ["netsuite"]),
    ("Odoo", ["odoo"]),
    ("Zoho ERP", ["zoho erp", "zoho finance"]),
    ("Tally ERP", ["tally erp", "tallyprime", "tally prime"]),
    ("Infor ERP", ["infor erp", "infor cloudsuite", "infor"]),
]
ERP_JOB_KEYWORDS = [
    ("SAP S/4HANA", ["S/4HANA", "SAP S4", "Fiori", "HANA"]),
    ("SAP Business One", ["SAP B1", "SAP Business One", "SAP BO"]),
    ("SAP", ["SAP MM", "SAP SD", "SAP FI", "SAP HR", "SAP ABAP", "SAP ECC", "SAP WM", "SAP PP"]),
    ("Oracle", ["Oracle EBS", "Oracle Fusion", "Oracle Apps", "JD Edwards", "PeopleSoft"]),
    ("Oracle NetSuite", ["NetSuite", "Netsuite"]),
    ("Microsoft Dynamics", ["Dynamics 365", "Dynamics AX", "Dynamics NAV", "Business Central", "D365", "MSCRM"]),
    ("Tally", ["TallyPrime", "Tally ERP", "Tally 9"]),
    ("Zoho", ["Zoho Books", "Zoho CRM", "Zoho ERP"]),
    ("Odoo", ["Odoo", "OpenERP"]),
    ("Busy", ["BUSY Software", "BUSY Accounting"]),
    ("Marg ERP", ["MARG ERP", "Marg Software"]),
    ("Infor", ["Infor ERP", "Infor LN", "Infor M3"]),
    ("Epicor", ["Epicor ERP", "Epicor"]),
]
GSTIN_PATTERN = r"[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z]{1}[1-9A-Z]{1}Z[0-9A-Z]{1}"

# directory profile pages: (role, pattern) in the order they are tried
PROFILE_RULES = {
    "directory1": {
        "contact": [
            ("Proprietor", r"Contact\s+Person\s*:?\s*(?:Mr\.?|Mrs\.?|Ms\.?|Dr\.?)?\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})"),
            ("Proprietor", r"Proprietor\s*:?\s*(?:Mr\.?|Mrs\.?|Ms\.?)?\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})"),
            ("Proprietor", r"Owner\s*:?\s*(?:Mr\.?|Mrs\.?|Ms\.?)?\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})"),
        ],
        "contact_cards": ".contact-person, .cp-name, [class*='contact'] strong, [class*='owner'], .propr-name, .contact-name",
        "turnover": [
            r"Annual\s+Turnover\s*:?\s*(Rs\.?\s*[\d.,]+\s*(?:Lakh|Crore|Cr|L)[^<\n]{0,40})",
            r"Turnover\s*:?\s*((?:Rs\.?|₹)\s*[\d.,]+\s*(?:Lakh|Crore|Cr)[^<\n]{0,30})",
        ],
        "employees": r"(?:No\.\s+of\s+Employees?|Employees?|Staff)\s*:?\s*([\d,]+\s*[-–to]*\s*[\d,]*\+?)",
        "nature": r"Nature\s+of\s+Business\s*:?\s*([A-Za-z\s/&]+?)(?:\n|<)",
        "address": "",
    },
    "directory2": {
        "contact": [
            ("Contact Person", r"Contact\s+Person\s*:?\s*(?:Mr\.?|Mrs\.?|Ms\.?|Dr\.?)?\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})"),
            ("Owner", r"Owner\s*:?\s*(?:Mr\.?|Mrs\.?|Ms\.?)?\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})"),
            ("Managing Director", r"Managing\s+Director\s*:?\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})"),
            ("Contact Person", r"Key\s+Contact\s*:?\s*(?:Mr\.?|Mrs\.?|Ms\.?)?\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})"),
        ],
        "contact_cards": ".contact-name, .contact-person, .cp-name, [class*='contact'] strong, [class*='owner'], .name",
        "turnover": [
            r"Annual\s+Turnover\s*:?\s*(Rs\.?\s*[\d.,]+\s*(?:Lakh|Crore|Cr|L)[^<\n]{0,40})",
            r"Turnover\s*(?:Rs\.?|₹)?:?\s*((?:Rs\.?|₹)\s*[\d.,]+\s*(?:Lakh|Crore|Cr)[^<\n]{0,30})",
            r"Sales\s+Turnover\s*:?\s*(Rs\.?\s*[\d.,]+\s*(?:Lakh|Crore|Cr)[^<\n]{0,30})",
        ],
        "employees": r"(?:No\.\s+of\s+(?:Employees?|Staff)|Employees?|Staff|Team\s+Size)\s*:?\s*([\d,]+\s*[-–to]*\s*[\d,]*\+?)",
        "nature": r"Nature\s+of\s+(?:Business|Company)\s*:?\s*([A-Za-z\s/&]+?)(?:\n|<)",
        "address": r"(?:Address|Location)\s*:?\s*([^\n]{10,150})",
    },
}
PROFILE_GST = r"GST\s*(?:No\.?|Number|IN)?\s*:?\s*([0-9]{2}[A-Z]{5}[0-9]{4}[A-Z]{1}[1-9A-Z]{1}Z[0-9A-Z]{1})"
OWNER_PATTERNS = [
    r"(?:led by|CEO is|headed by|MD is)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})",
    r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})\s+(?:is|serves as)\s+(?:the\s+)?(?:CEO|MD|Chairman)",
    r"founded by\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})",
]
CORPORATE_TITLE_WORDS = ["Limited", "Ltd", "Inc", "Corp", "Industries", "Technologies"]
SNIPPET_NAME_PATTERNS = [
    r"(?:Director|DIN|Signatory)\s*:?\s*([A-Z][A-Z\s]{4,40})",
    r"([A-Z][A-Z\s]{4,30})\s+(?:Director|CEO|MD|CFO)",
]

# --- places ----------------------------------------------------------------

INDIAN_STATES = [
    "andhra pradesh", "arunachal pradesh", "assam", "bihar", "chhattisgarh", "goa", "gujarat", "haryana",
    "himachal pradesh", "jharkhand", "karnataka", "kerala", "madhya pradesh", "maharashtra", "manipur", "meghalaya",
    "mizoram", "nagaland", "odisha", "punjab", "rajasthan", "sikkim", "tamil nadu", "telangana", "tripura",
    "uttar pradesh", "uttarakhand", "west bengal", "delhi", "jammu and kashmir", "ladakh",
    "andaman and nicobar islands", "chandigarh", "dadra and nagar haveli", "daman and diu", "lakshadweep",
    "puducherry",
]
COUNTRY_TOKENS = {
    "india": "India", "usa": "United States", "us": "United States", "uk": "United Kingdom", "gb": "United Kingdom",
    "uae": "United Arab Emirates", "germany": "Germany", "france": "France", "canada": "Canada", "ca": "Canada",
    "australia": "Australia", "au": "Australia", "singapore": "Singapore", "sg": "Singapore", "japan": "Japan",
    "china": "China", "br": "Brazil", "mx": "Mexico", "nl": "Netherlands", "es": "Spain", "it": "Italy",
    "de": "Germany", "ru": "Russia", "kr": "South Korea", "za": "South Africa", "ae": "United Arab Emirates",
    "ph": "Philippines", "my": "Malaysia", "th": "Thailand", "vn": "Vietnam", "id": "Indonesia", "eg": "Egypt",
    "pk": "Pakistan", "bd": "Bangladesh", "lk": "Sri Lanka",
}
US_STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO",
    "connecticut": "CT", "delaware": "DE", "florida": "FL", "georgia": "GA", "hawaii": "HI", "idaho": "ID",
    "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY", "louisiana": "LA",
    "maine": "ME", "maryland": "MD", "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS",
    "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ",
    "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH",
    "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC",
    "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA",
    "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY", "dc": "DC",
}
UK_COUNTIES = [
    "bedfordshire", "berkshire", "bristol", "buckinghamshire", "cambridgeshire", "cheshire", "cornwall", "cumbria",
    "derbyshire", "devon", "dorset", "durham", "east yorkshire", "east sussex", "essex", "gloucestershire",
    "greater london", "greater manchester", "hampshire", "herefordshire", "hertfordshire", "isle of wight", "kent",
    "lancashire", "leicestershire", "lincolnshire", "london", "norfolk", "north yorkshire", "northamptonshire",
    "northumberland", "nottinghamshire", "oxfordshire", "rutland", "shropshire", "somerset", "south yorkshire",
    "staffordshire", "suffolk", "surrey", "tyne and wear", "warwickshire", "west midlands", "west sussex",
    "west yorkshire", "wiltshire", "worcestershire",
]
CANADIAN_PROVINCES = {
    "alberta": "AB", "british columbia": "BC", "manitoba": "MB", "new brunswick": "NB",
    "newfoundland and labrador": "NL", "nova scotia": "NS", "ontario": "ON", "prince edward island": "PE",
    "quebec": "QC", "saskatchewan": "SK", "northwest territories": "NT", "nunavut": "NU", "yukon": "YT",
}
CITY_ALIASES = {
    "bengaluru": "Bengaluru", "bangalore": "Bengaluru", "gauhati": "Guwahati", "bombay": "Mumbai",
    "calcutta": "Kolkata", "madras": "Chennai", "poona": "Pune", "secunderabad": "Hyderabad", "new delhi": "Delhi",
    "delhi ncr": "Delhi", "ncr": "Delhi",
}
KNOWN_CITIES = [
    "mumbai", "delhi", "bengaluru", "bangalore", "chennai", "hyderabad", "pune", "kolkata", "ahmedabad", "jaipur",
    "lucknow", "kanpur", "nagpur", "indore", "bhopal", "patna", "gurgaon", "gauhati", "guwahati", "surat",
    "vadodara", "kochi", "ludhiana", "agra", "meerut", "nashik", "faridabad", "ranchi", "raipur", "dehradun",
    "haridwar", "visakhapatnam", "vijayawada", "tirupati", "nellore", "coimbatore", "madurai", "trichy", "salem",
    "tirunelveli", "vellore", "mangalore", "mysore", "hubli", "belgaum", "dhanbad", "jamshedpur", "asansol",
    "durgapur", "howrah", "siliguri", "bhubaneswar", "cuttack", "bokaro", "varanasi", "prayagraj", "aligarh",
    "mathura", "agartala", "imphal", "shillong", "itanagar", "gangtok", "thiruvananthapuram", "kottayam", "thrissur",
    "ernakulam", "kollam",
]
US_CITIES = [
    "new york", "los angeles", "chicago", "houston", "phoenix", "philadelphia", "san antonio", "san diego", "dallas",
    "san jose", "austin", "jacksonville", "fort worth", "columbus", "charlotte", "san francisco", "indianapolis",
    "seattle", "denver", "boston", "detroit", "el paso", "memphis", "nashville", "portland", "oklahoma city",
    "las vegas", "louisville", "baltimore", "milwaukee", "albuquerque", "tucson", "fresno", "mesa", "sacramento",
    "atlanta", "kansas city", "colorado springs", "miami", "raleigh", "omaha", "long beach", "virginia beach",
    "oakland", "minneapolis", "tulsa", "arlington", "tampa", "new orleans",
]
UK_CITIES = [
    "london", "birmingham", "manchester", "glasgow", "liverpool", "leeds", "sheffield", "edinburgh", "bristol",
    "cardiff", "belfast", "nottingham", "southampton", "brighton", "leicester", "oxford", "cambridge", "coventry",
    "york",
]
CITY_SKIP_WORDS = [
    "street", "road", "lane", "avenue", "sector", "phase", "building", "floor", "plot", "near", "opposite", "behind",
    "station", "area", "nagar", "colony", "village", "town", "city", "district", "block", "tower", "park", "estate",
    "premises", "chambers", "office", "division", "tech", "corporate", "head", "branch", "center", "centre",
    "complex", "suite", "room", "market", "house",
]
NOT_A_CITY = [
    "ppg division", "corporate office", "head office", "branch office", "tech village", "tech park", "building",
    "tower", "block", "sector", "phase", "plot", "industrial area", "estate", "premises", "chambers", "floor",
    "suite", "room", "near", "opposite", "behind", "station", "road", "lane", "street", "market", "nagar", "colony",
]
TEXT_CITY_PATTERNS = [
    r"\b(mumbai|delhi|bangalore|bengaluru|chennai|hyderabad|pune|kolkata|ahmedabad|jaipur|lucknow|kanpur|nagpur|"
    r"indore|bhopal|patna|gurgaon|surat|vadodara|kochi|ludhiana|agra|meerut|nashik|faridabad)\b",
    r"\b(new york|los angeles|chicago|houston|phoenix|philadelphia|san antonio|san diego|dallas|san jose|austin|"
    r"jacksonville)\b",
    r"\b(london|birmingham|manchester|glasgow|liverpool|leeds|sheffield|edinburgh|bristol)\b",
    r"(?:located in|headquartered in|based in|city[:\s]+)([a-zA-Z\s]+?)(?:,|\.|$)",
    r"address[:\s]+([a-zA-Z\s,]+?)(?:,|\.|$)",
]
UK_POSTCODE = r"(?i)\b[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}\b"
US_ZIP = r"\b\d{5}(?:-\d{4})?\b"
PIN_CODE = r"\b\d{6}\b"

# --- search parameters and routing ----------------------------------------

KEYWORD_COLUMNS = ["keyword", "Company Name", "company_name", "Company", "Website", "website"]
LOCATION_COLUMNS = ["location", "Address"]
INDUSTRY_COLUMNS = ["industry", "Industry_Type", "industry_type"]
ERP_TRIGGERS = ["erp", "sap", "oracle", "odoo", "tally", "zoho"]
ERP_VARIANTS = [
    "ERP companies", "ERP software providers", "enterprise resource planning companies", "ERP vendors",
    "SAP partners", "Oracle ERP partners", "Microsoft Dynamics partners", "ERP implementation firms",
]
DIRECTORY_CITIES = [
    "kolkata", "mumbai", "delhi", "bangalore", "bengaluru", "hyderabad", "chennai", "pune", "ahmedabad", "surat",
    "jaipur", "lucknow", "kanpur", "nagpur", "jamshedpur", "durgapur", "howrah", "siliguri", "asansol", "bardhaman",
    "india",
]
DIRECTORY_INDUSTRIES = [
    "manufacturer", "oil", "lubricant", "chemical", "steel", "textile", "garment", "plastic", "food", "pharma",
    "engineering", "construction", "electronics", "furniture",
]
DEFAULT_DIRECTORY_CITY = "kolkata"
QUERY_CITIES = [
    "new delhi", "navi mumbai", "west bengal", "kolkata", "mumbai", "delhi", "bangalore", "bengaluru", "hyderabad",
    "chennai", "pune", "ahmedabad", "surat", "jaipur", "lucknow", "kanpur", "nagpur", "indore", "thane", "bhopal",
    "visakhapatnam", "patna", "vadodara", "ghaziabad", "ludhiana", "agra", "nashik", "ranchi", "faridabad", "meerut",
    "rajkot", "varanasi", "aurangabad", "dhanbad", "amritsar", "howrah", "coimbatore", "jodhpur", "madurai",
    "raipur", "kota", "chandigarh", "guwahati", "solapur", "hubballi", "mysuru", "bareilly", "aligarh", "moradabad",
    "gurgaon", "gurugram", "noida", "pimpri", "kalyan", "vasai", "jamshedpur", "durgapur", "asansol", "bardhaman",
    "siliguri", "india",
]
PLATFORMS = [
    "discovery", "google", "maps", "website", "linkedin", "indiamart", "tradeindia", "justdial", "clutch",
    "goodfirms", "google_places", "searx", "direct_website",
]
DEFAULT_SOURCES = ["google", "maps", "indiamart", "tradeindia", "justdial", "linkedin", "searx"]
WEBSITES_PER_QUERY = 10
SOURCE_CAPS = {
    "google": 10, "discovery": 15, "searx": 15, "indiamart": 20, "goodfirms": 20, "clutch": 25, "maps": 8,
    "tradeindia": 12, "justdial": 12, "justdial_cards": 15, "linkedin": 5, "google_places": 10,
}
GUESS_TLDS = [".com", ".co.in", ".in", ".org", ".net"]
REQUEST_VERBS = (
    r"(?i)^(?:find|get|search\s+for|look\s+for|discover|show\s+me|list|give\s+me|fetch|scrape|i\s+want|i\s+need)\s+"
)
REQUEST_LOCATION = (
    r"(?i)\b(?:in|near|from|at|around|across)\s+([A-Za-z][a-zA-Z\s]+?)"
    r"(?=\s+(?:who|that|which|providing|with|for|and|,|\.|$)|[,.]|$)"
)
MARKETPLACE_HOSTS = [
    "www.justdial.com", "justdial.com", "www.indiamart.com", "indiamart.com", "www.tradeindia.com", "tradeindia.com",
]
SEARCH_ENGINE_HOSTS = ["duckduckgo.com", "google.com", "bing.com", "yahoo.com", "baidu.com", "yandex.com"]
DISCOVERY_ENOUGH = 10
DISCOVERY_CITIES = 5

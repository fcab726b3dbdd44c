"""SQL statements of the same rules for the side-by-side check.

Text patterns follow the syntax both engines read.  Where word boundaries
meet accented letters, letters outside ASCII are first replaced by a plain
letter that occurs in none of the words looked for.
"""

from __future__ import annotations

from leadloom.functions import fixed
from leadloom.functions.text import HIDDEN, SPACE, SPACE_CHARS, TAG, any_of
from leadloom.schema import RECORD_FIELDS
from registry.views import PHRASES


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lits(values) -> str:
    return ", ".join(lit(v) for v in values)


def rx(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(pattern)})"


def ext(x: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({x}, {lit(pattern)}, {group})"


def ext_all(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({x}, {lit(pattern)}, {group})"


def sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(to)}, 'g')"


def plain(x: str) -> str:
    """Accented letters as q or Q."""
    return sub(sub(x, r"[\x{c0}-\x{d6}\x{d8}-\x{de}]", "Q"), r"[\x{df}-\x{f6}\x{f8}-\x{24f}]", "q")


def first_filled(*xs: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({x}, '')" for x in xs) + ", '')"


def count(x: str, pattern: str) -> str:
    return f"len({ext_all(x, pattern)})"


def squeeze(x: str) -> str:
    return f"trim({sub(x, SPACE + '+', ' ')})"


def title(x: str) -> str:
    runs = ext_all(x, r"\p{L}+|[^\p{L}]+")
    return f"array_to_string(list_transform({runs}, lambda r: upper(left(r, 1)) || lower(substr(r, 2))), '')"


def distinct_in_order(xs: str) -> str:
    return f"(SELECT list_filter(l, lambda x, i: list_position(l, x) = i) FROM (SELECT {xs} AS l))"


def unescape(x: str) -> str:
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"),
                         ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, {lit(entity)}, {lit(char)})"
    return x


def page_text(html: str) -> str:
    marked = unescape(f"regexp_replace(regexp_replace({html}, {lit(HIDDEN)}, chr(1), 'g'), {lit(TAG)}, chr(1), 'g')")
    joined = sub(marked, rf"{SPACE}*(?:\x01{SPACE}*)+", " ")
    return sub(joined, rf"^{SPACE}+|{SPACE}+$")


def fragment_text(x: str, glue: str) -> str:
    marked = unescape(f"regexp_replace(regexp_replace({x}, {lit(HIDDEN)}, chr(1), 'g'), {lit(TAG)}, chr(1), 'g')")
    edges = sub(marked, rf"^(?:{SPACE}|\x01)+|(?:{SPACE}|\x01)+$")
    return sub(edges, rf"{SPACE}*(?:\x01{SPACE}*)+", glue)


def page_title(html: str) -> str:
    return squeeze(unescape(ext(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>")))


# --- contacts --------------------------------------------------------------

def valid_email(x: str) -> str:
    m = f"lower(trim({x}))"
    local, domain = f"split_part({m}, '@', 1)", f"split_part({m}, '@', -1)"
    full = "^" + fixed.EMAIL_PATTERN.replace("A-Z", "") + "$"
    return (
        f"({rx(m, full)} AND length({local}) <= 64 AND length({domain}) <= 255 AND NOT {rx(local, r'\.\.|^\.|\.$')}"
        f" AND {domain} NOT IN ({lits(fixed.DISPOSABLE_DOMAINS)})"
        f" AND NOT (starts_with({m}, 'noreply') OR starts_with({m}, 'no-reply') OR starts_with({m}, 'donotreply'))"
        f" AND split_part({domain}, '.', -1) IN ({lits(fixed.EMAIL_TLDS)})"
        + "".join(f" AND NOT contains({m}, {lit(p)})" for p in fixed.SUSPICIOUS_EMAIL_PARTS) + ")"
    )


def free_mail(x: str) -> str:
    return f"(split_part(replace(split_part(lower(trim({x})), '@', -1), 'www.', ''), '.', 1) IN ({lits(fixed.FREE_MAIL_NAMES)}))"


def emails(text: str, limit: int = 5) -> str:
    found = f"list_transform({ext_all(text, fixed.EMAIL_PATTERN)}, lambda m: lower(m))"
    return (
        "(SELECT CASE WHEN len(list_filter(v, lambda m: NOT " + free_mail("m") + f")) > 0 THEN list_filter(v, lambda m: NOT {free_mail('m')})[1:{limit}]"
        f" ELSE v[1:{limit}] END FROM (SELECT list_filter(l, lambda x, i: list_position(l, x) = i AND {valid_email('x')}) AS v"
        f" FROM (SELECT {found} AS l)))"
    )


def digits(x: str) -> str:
    return sub(x, "[^0-9]")


def valid_phone(x: str) -> str:
    d = digits(x)
    return (
        f"(length({d}) BETWEEN 10 AND 15 AND {d} NOT IN ({lits(fixed.FAKE_PHONES)})"
        f" AND replace({d}, left({d}, 1), '') <> '' AND NOT (length({d}) = 10 AND starts_with({d}, '0')))"
    )


def plus_phone(x: str) -> str:
    return f"(CASE WHEN {valid_phone(x)} THEN '+' || {digits(x)} ELSE '' END)"


def phones(text: str, limit: int = 5) -> str:
    parts = [
        f"list_transform({ext_all(text, p)}, lambda m: {{'place': strpos({text}, trim(m)), 'rule': {n}, 'raw': trim(m)}})"
        for n, p in enumerate(fixed.PHONE_PATTERNS)
    ]
    both = parts[0]
    for p in parts[1:]:
        both = f"list_concat({both}, {p})"
    numbers = (
        f"(SELECT list('+' || d ORDER BY place, rule, d) FROM (SELECT DISTINCT m.place AS place, m.rule AS rule,"
        f" {digits('m.raw')} AS d FROM (SELECT unnest({both}) AS m) WHERE {valid_phone('m.raw')}))"
    )
    return f"(SELECT coalesce(list_filter(l, lambda x, i: list_position(l, x) = i), [])[1:{limit}] FROM (SELECT {numbers} AS l))"


def normalize_phone(x: str) -> str:
    k = sub(x, "[^0-9+]")
    return (
        f"(CASE WHEN starts_with({k}, '91') AND length({k}) > 10 THEN '+' || {k}"
        f" WHEN starts_with({k}, '0') AND length({k}) = 11 THEN '+91' || substr({k}, 2) ELSE {k} END)"
    )


# --- text quality, urls, names --------------------------------------------

def garbled(x: str) -> str:
    foreign = f"length({sub(x, r'[\x00-\x7F]')})"
    return (
        f"({rx(x, r'[\x00-\x1f\x7f-\x{9f}]|[\x{c0}-\x{ff}]{3,}|[\x{fffc}-\x{ffff}]')}"
        f" OR ({foreign} > length({x}) * 0.3::DOUBLE AND {foreign} > 10))"
    )


def meaningful(x: str) -> str:
    two = rf"[^{SPACE_CHARS}]{SPACE}+[^{SPACE_CHARS}]"
    return f"(length({x}) >= 5 AND {rx(x, two)} AND length({sub(x, '[^a-zA-Z]')}) * 2 >= length({x}))"


def valid_description(x: str) -> str:
    lorem = " AND ".join(f"NOT contains(lower({x}), {lit(p)})" for p in fixed.LOREM)
    return f"({x} = '' OR (length({x}) >= 30 AND {lorem} AND NOT {garbled(x)}))"


def host(x: str) -> str:
    return ext(x, r"^https?://([^/?#]*)")


def with_scheme(x: str) -> str:
    return f"(CASE WHEN {rx(x, '^https?://')} THEN {x} ELSE 'https://' || {x} END)"


def valid_url(x: str) -> str:
    u = with_scheme(x)
    return f"({x} <> '' AND contains({host(u)}, '.') AND length({host(u)}) >= 5 AND NOT {rx(u, r'[{}\\^`~\[\]|]')})"


def normalize_url(x: str) -> str:
    u = with_scheme(f"trim({x})")
    parts = r"^(https?)://([^/?#]*)([^?#]*)(\?[^#]*)?"
    path = sub(sub(ext(u, parts, 3), ";[^/]*$"), "/+$")
    return (
        f"(CASE WHEN trim({x}) = '' THEN '' ELSE {ext(u, parts, 1)} || '://' || {sub(f'lower({ext(u, parts, 2)})', '^www\\.')}"
        f" || {path} || coalesce(nullif({ext(u, parts, 4)}, '?'), '') END)"
    )


def path(x: str) -> str:
    return sub(ext(x, r"^https?://[^/?#]*([^?#]*)"), ";[^/]*$")


def norm_key(x: str) -> str:
    return sub(f"lower(coalesce({x}, ''))", r"[^\p{L}\p{N}_]")


def name_score(x: str, domain: str | None = None) -> str:
    invalid = "(?i)" + "|".join(dict.fromkeys(fixed.INVALID_NAME_PATTERNS))
    suffix = rf"(?i)\b(?:{any_of(fixed.LEGAL_SUFFIXES)})\b\.?"
    p = plain(x)
    core = f"trim({sub(p, suffix)})"
    n, caps = count(core, "[^ ]+"), count(f"(' ' || {core})", r" \p{Lu}")
    refused = (
        f"(coalesce({x}, '') = '' OR {rx(x, r'[<>{}\[\]|\\^`~]')} OR {rx(x, invalid)}"
        f" OR length({sub(x, '[^a-zA-Z]')}) < 3 OR ({rx(x, '^[0-9]')} AND length({x}) < 10)"
        f" OR {count(x, r'\(')} <> {count(x, r'\)')} OR {count(x, '[^ ]+')} > 15 OR length({x}) > 200)"
    )
    score = (
        f"1 + CASE WHEN {n} BETWEEN 2 AND 6 THEN 2 WHEN {n} = 1 AND length({core}) >= 4 THEN 1 WHEN {n} > 6 THEN -1 ELSE 0 END"
        f" + CASE WHEN {caps} * 10 > {n} * 7 THEN 1 ELSE 0 END + CASE WHEN {rx(p, suffix)} THEN 1 ELSE 0 END"
    )
    if domain is not None:
        base = f"split_part(replace(lower({domain}), 'www.', ''), '.', 1)"
        flat = sub(f"lower({x})", "[ _-]")
        score += f" + CASE WHEN {domain} <> '' AND (contains({flat}, {base}) OR contains({base}, {flat})) THEN 2 ELSE 0 END"
    return f"(CASE WHEN {refused} THEN 0 ELSE greatest(0, {score}) END)"


def clean_name(x: str) -> str:
    return sub(sub(squeeze(x), rf"^[{SPACE_CHARS}\-–—|.:;]+|[{SPACE_CHARS}\-–—|.:;]+$"), r"[\x00-\x1f\x7f-\x{9f}]")


def clean_text(x: str) -> str:
    return squeeze(sub(unescape(unescape(sub(x, "<[^>]+>", " "))), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"))


# --- facts -----------------------------------------------------------------

def band(n: str) -> str:
    steps = " ".join(f"WHEN {n} <= {top} THEN {lit(name)}" for top, name in fixed.EMPLOYEE_BANDS)
    return f"(CASE WHEN {n} IS NULL THEN NULL {steps} ELSE {lit(fixed.EMPLOYEE_TOP_BAND)} END)"


def employee_band(x: str) -> str:
    parts = []
    for p in fixed.EMPLOYEE_PATTERNS:
        n = f"try_cast(replace({ext(x, '(?i)' + p)}, ',', '') AS BIGINT)"
        parts.append(f"CASE WHEN {n} BETWEEN 1 AND {fixed.MAX_EMPLOYEES} THEN {band(n)} END")
    return f"coalesce({', '.join(parts)}, '')"


def turnover(x: str) -> str:
    parts = []
    for p in fixed.TURNOVER_PATTERNS:
        a, u = ext(x, "(?i)" + p, 1), ext(x, "(?i)" + p, 2)
        parts.append(f"CASE WHEN {a} <> '' THEN '₹' || {a} || ' ' || upper(left({u}, 1)) || lower(substr({u}, 2)) END")
    return f"coalesce({', '.join(parts)}, '')"


def branch_count(x: str) -> str:
    return squeeze(first_filled(*[ext(x, "(?i)" + p) for p in fixed.BRANCH_PATTERNS]))


def contact_name(x: str) -> str:
    return f"trim({first_filled(*[ext(x, '(?i)' + p) for p in fixed.CONTACT_PATTERNS])})"


def erp_by_pattern(x: str) -> str:
    steps = " ".join(f"WHEN {rx(plain(x), '(?i)' + p)} THEN {lit(n)}" for n, p in fixed.ERP_PATTERNS)
    return f"(CASE {steps} ELSE '' END)"


def erp_by_phrase(x: str) -> str:
    padded = f"(' ' || lower({x}) || ' ')"
    steps = " ".join(
        "WHEN " + " OR ".join(f"contains({padded}, {lit(w)})" for w in ws) + f" THEN {lit(n)}" for n, ws in fixed.ERP_PHRASES)
    return f"(CASE {steps} ELSE '' END)"


def detect_erp(x: str) -> str:
    return first_filled(erp_by_pattern(x), erp_by_phrase(x))


def industry_of(x: str) -> str:
    steps = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({x}), {lit(w)})" for w in ws) + f" THEN {lit(n)}"
        for n, ws in fixed.INDUSTRY_KEYWORDS.items())
    return f"(CASE {steps} ELSE '' END)"


def case_of(x: str, table: dict[str, str], otherwise: str = "NULL") -> str:
    steps = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items())
    return f"(CASE {x} {steps} ELSE {otherwise} END)"


def normalize_industry(x: str) -> str:
    return f"(CASE WHEN {x} = '' THEN '' ELSE {case_of(f'lower(trim({x}))', fixed.INDUSTRY_NAMES, title(f'trim({x})'))} END)"


def gstin(x: str) -> str:
    return ext(f"upper({x})", f"({fixed.GSTIN_PATTERN})")


# --- places ----------------------------------------------------------------

def token(low: str, names) -> str:
    return ext(plain(low), rf"\b({any_of(list(names))})\b")


def address_parts(x: str) -> dict[str, str]:
    from leadloom.functions.places import CITIES, CITY_NAMES

    low = f"lower({x})"
    us, county = token(low, fixed.US_STATES), token(low, fixed.UK_COUNTIES)
    province, indian = token(low, fixed.CANADIAN_PROVINCES), token(low, fixed.INDIAN_STATES)
    country = case_of(token(low, fixed.COUNTRY_TOKENS), fixed.COUNTRY_TOKENS)
    state = (
        f"(CASE WHEN {indian} <> '' THEN {title(indian)} WHEN {province} <> '' THEN {case_of(province, fixed.CANADIAN_PROVINCES)}"
        f" WHEN {us} <> '' THEN {case_of(us, fixed.US_STATES)} ELSE {title(county)} END)"
    )
    nation = (
        f"coalesce({country}, CASE WHEN {indian} <> '' THEN 'India' WHEN {province} <> '' THEN 'Canada'"
        f" WHEN {us} <> '' THEN 'United States' WHEN {county} <> '' THEN 'United Kingdom' ELSE 'India' END)"
    )
    pincode = first_filled(ext(x, fixed.PIN_CODE, 0), ext(x, fixed.US_ZIP, 0), f"upper({ext(x, fixed.UK_POSTCODE, 0)})")
    hit = f"list_filter([{lits(CITIES)}], lambda c: contains({low}, c))[1]"
    city = first_filled(f"coalesce({case_of(hit, CITY_NAMES)}, '')", city_from_parts(x))
    return {"city": city, "state": state, "country": nation, "pincode": pincode}


def city_from_parts(x: str) -> str:
    unwanted = any_of(fixed.CITY_SKIP_WORDS + fixed.INDIAN_STATES + list(fixed.COUNTRY_TOKENS) + list(fixed.US_STATES)
                      + list(fixed.CANADIAN_PROVINCES))
    parts = f"list_transform(regexp_split_to_array({x}, '[,|\\-\\n]'), lambda p: trim(p))"
    good = (
        f"list_filter({parts}, lambda p: length(p) BETWEEN 5 AND 39 AND {rx('p', r'^\p{Lu}\p{Ll}')}"
        f" AND NOT {rx('lower(p)', unwanted)} AND (NOT {rx('p', '[0-9]')} OR {rx('p', '[0-9]{6}')})"
        f" AND {count('p', '[^ ]+')} <= 2)[1]"
    )
    return f"coalesce({title(good)}, '')"


def full_address_parts(x: str) -> dict[str, str]:
    parts = address_parts(x)
    bad = rx(f"lower({parts['city']})", any_of(fixed.NOT_A_CITY))
    parts["city"] = f"(CASE WHEN {bad} THEN '' ELSE {parts['city']} END)"
    return {k: f"(CASE WHEN {x} = '' THEN '' ELSE {v} END)" for k, v in parts.items()}


def text_location(x: str) -> dict[str, str]:
    low = f"lower({x})"
    cities = []
    for n, p in enumerate(fixed.TEXT_CITY_PATTERNS):
        c = f"trim({ext(plain(low) if n < 3 else low, p)})"
        cities.append(f"CASE WHEN length({c}) BETWEEN 3 AND 39 THEN {c} END")
    us, indian = token(low, fixed.US_STATES), token(low, fixed.INDIAN_STATES)
    return {
        "city": title(f"coalesce({', '.join(cities)}, '')"),
        "state": f"(CASE WHEN {us} <> '' THEN {case_of(us, fixed.US_STATES)} ELSE {title(indian)} END)",
        "country": f"coalesce({case_of(token(low, fixed.COUNTRY_TOKENS), fixed.COUNTRY_TOKENS)},"
                   f" CASE WHEN {us} <> '' THEN 'United States' ELSE 'India' END)",
    }


# --- views -----------------------------------------------------------------

def record_select(table: str, **fields: str) -> str:
    cols = [f"{fields.get(f, lit(''))} AS {f}" for f in RECORD_FIELDS]
    return f"SELECT {fields['ord']} AS ord, {', '.join(cols)} FROM {table}"


def page_records() -> str:
    own = (f"SELECT page_id, url, {page_title('html')} AS ttl, {squeeze(page_text('html'))} AS txt FROM pages")
    return record_select(
        f"(SELECT *, {emails('txt', 1)} AS ml, {phones('txt', 1)} AS ph FROM ({own}))", ord="page_id",
        company_name="ttl", website="url", email="coalesce(ml[1], '')", phone="coalesce(ph[1], '')", description="txt",
        source=host("url"), additional_info="'web profile: ' || url",
    )


def entity_records() -> str:
    values = ", ".join(f"({n}, {lits(p)})" for n, p in enumerate(PHRASES))
    both = (
        "SELECT c_custkey * 2 AS ord, c_custkey AS k, c_nationkey AS nk, c_mktsegment AS industry, 'customers' AS source"
        " FROM customer UNION ALL SELECT s_suppkey * 2 + 1, s_suppkey, s_nationkey, '', 'suppliers' FROM supplier"
    )
    src = (
        f"(SELECT b.*, p.*, n_name, lower(replace(prefix, ' ', '')) AS h, (k % 37)::VARCHAR AS g FROM ({both}) b"
        f" JOIN (VALUES {values}) p(slot, prefix, phone, address, description, info) ON b.k % {len(PHRASES)} = p.slot"
        " JOIN nation ON n_nationkey = nk)"
    )
    return record_select(
        src, ord="ord",
        company_name="prefix || ' ' || CASE WHEN industry = '' THEN 'Supply House' ELSE upper(left(industry, 1)) || lower(substr(industry, 2)) || ' Works' END",
        website="'http://www.' || h || g || '.co.in/'", email="'Sales' || g || '@' || h || '.co.in'", phone="phone",
        address="address", industry="industry", description="description", additional_info="info", source="source",
        country="CASE WHEN k % 5 = 0 THEN n_name ELSE '' END",
    )


def replace_fields(source: str, fields: dict[str, str]) -> str:
    listed = ", ".join(f"{v} AS {k}" for k, v in fields.items())
    return f"SELECT * REPLACE ({listed}) FROM {source}"


def cleaned(source: str) -> str:
    """Statement that cleans the records of ``source`` (a table or parenthesised statement)."""
    texts = replace_fields(source, {f: clean_text(f) for f in RECORD_FIELDS})
    good = valid_url("website")
    domain = f"(CASE WHEN {good} THEN {host('website')} ELSE '' END)"
    return replace_fields(f"({texts})", {
        "company_name": f"CASE WHEN {name_score('company_name', domain)} >= 3 THEN company_name ELSE '' END",
        "website": f"CASE WHEN {good} THEN lower(website) ELSE '' END",
        "email": f"CASE WHEN {valid_email('email')} THEN lower(email) ELSE '' END",
        "phone": plus_phone("phone"),
        "description": f"CASE WHEN {valid_description('description')} THEN left(description, 1000) ELSE '' END",
        "address": f"CASE WHEN {meaningful('address')} THEN left(address, 500) ELSE '' END",
    })


def quality() -> str:
    name = name_score("company_name", "website")
    industry = first_filled("industry", "industry_type")
    return (
        f"(((CASE WHEN {name} >= 4 THEN 32 WHEN {name} >= 3 THEN 22 ELSE 0 END)"
        " + (CASE WHEN website <> '' THEN 17 ELSE 0 END)"
        f" + (CASE WHEN email = '' THEN 0 WHEN {valid_email('email')} AND NOT {free_mail('email')} THEN 22 ELSE 17 END)"
        " + (CASE WHEN phone <> '' THEN 17 ELSE 0 END)"
        " + (CASE WHEN address <> '' OR city <> '' OR state <> '' THEN 12 ELSE 0 END)"
        " + (CASE WHEN city <> '' THEN 5 ELSE 0 END) + (CASE WHEN state <> '' THEN 3 ELSE 0 END)"
        f" + (CASE WHEN {industry} <> '' AND {meaningful(industry)} THEN 7 ELSE 0 END)"
        f" + (CASE WHEN length(description) > 50 AND {meaningful('description')} THEN 12 WHEN length(description) > 20 THEN 3 ELSE 0 END)"
        ") / 10.0)"
    )


def normalized(source: str) -> str:
    fields = {f: squeeze(f) for f in ("company_name", "address", "description", "additional_info", "source",
                                      "employee_count", "branch_count", "turnover", "contact_name", "erp_software")}
    fields |= {f: title(squeeze(f)) for f in ("city", "state", "country")}
    fields |= {f: normalize_industry(f) for f in ("industry", "industry_type")}
    fields |= {"website": normalize_url("website"), "phone": normalize_phone("phone"), "email": "lower(trim(email))"}
    return replace_fields(source, fields)


def _text(*fields: str) -> str:
    return "concat_ws(' ', " + ", ".join(fields) + ")"


def enriched(source: str) -> str:
    own = f"(SELECT *, {_text('company_name', 'industry', 'description', 'additional_info', 'address')} AS txt FROM {source})"
    kind = first_filled("industry_type", "industry", industry_of("txt"))
    info = "left(additional_info, 300)"
    return (
        replace_fields(own, {
            "industry_type": kind, "industry": first_filled("industry", kind),
            "employee_count": first_filled("employee_count", employee_band("txt")),
            "turnover": first_filled("turnover", turnover("txt")),
            "branch_count": first_filled("branch_count", branch_count("txt")),
            "contact_name": first_filled("contact_name", contact_name("txt")),
            "erp_software": first_filled(detect_erp("txt"), "erp_software"),
            "description": first_filled("description", f"CASE WHEN length({info}) > 20 THEN {info} END"),
        }).replace("SELECT * REPLACE", "SELECT * EXCLUDE (txt) REPLACE", 1)
    )


def enriched_text(source: str) -> str:
    own = f"(SELECT *, {_text('description', 'additional_info', 'company_name')} AS txt FROM {source})"
    return replace_fields(own, {
        "employee_count": first_filled("employee_count", employee_band("txt")),
        "turnover": first_filled("turnover", turnover("txt")),
        "erp_software": first_filled("erp_software", erp_by_pattern("txt")),
    }).replace("SELECT * REPLACE", "SELECT * EXCLUDE (txt) REPLACE", 1)


def located(source: str) -> str:
    own = f"(SELECT *, {_text('additional_info', 'description')} AS txt FROM {source})"
    a, w = full_address_parts("address"), text_location("txt")
    none = "address = '' AND city = ''"
    at = {k: f"(CASE WHEN {none} THEN {w[k]} ELSE {a[k]} END)" for k in ("city", "state", "country")}
    return replace_fields(own, {
        "city": first_filled("city", at["city"]), "state": first_filled("state", at["state"]),
        "country": first_filled("country", at["country"]),
        "pincode": first_filled(f"(CASE WHEN {none} THEN '' ELSE {a['pincode']} END)", "pincode"),
    }).replace("SELECT * REPLACE", "SELECT * EXCLUDE (txt) REPLACE", 1)


def folded(list_of_info: str) -> str:
    """Info texts in order, each left out when equal to all before it."""
    return (
        f"coalesce(list_reduce({list_of_info}, lambda a, b: CASE WHEN a = b THEN a ELSE a || ' | ' || b END), '')"
    )


def merged(source: str, keys: list[str]) -> str:
    cols = []
    for f in RECORD_FIELDS:
        if f == "additional_info":
            infos = "list(additional_info ORDER BY ord) FILTER (additional_info <> '')"
            cols.append(f"{infos} AS infos")
        elif f in fixed.MERGE_FIELDS:
            cols.append(f"coalesce(arg_min({f}, ord) FILTER ({f} <> ''), '') AS {f}")
        else:
            cols.append(f"arg_min({f}, ord) AS {f}")
    inner = f"SELECT {', '.join(keys)}, min(ord) AS o, count(*) AS n_records, {', '.join(cols)} FROM {source} GROUP BY {', '.join(keys)}"
    reduced = "CASE WHEN infos IS NULL THEN '' ELSE " + folded("infos") + " END"
    listed = ", ".join(f if f != "additional_info" else f"{reduced} AS additional_info" for f in RECORD_FIELDS)
    return f"SELECT o AS ord, n_records, {listed}, {', '.join(keys)} FROM ({inner})"


def exact_merged(source: str) -> str:
    own = f"(SELECT *, {norm_key('company_name')} AS nk, {norm_key('website')} AS wk, {norm_key('email')} AS mk FROM {source})"
    return f"SELECT * EXCLUDE (nk, wk, mk) FROM ({merged(own, ['nk', 'wk', 'mk'])})"


def output_columns(source: str) -> str:
    cols = []
    for name, field in fixed.OUTPUT_COLUMNS:
        value = "(row_number() OVER (ORDER BY ord))::VARCHAR" if not field else (
            first_filled("industry_type", "industry") if field == "industry_type" else field)
        cols.append(f'{value} AS "{name}"')
    return f"SELECT {', '.join(cols)} FROM {source}"

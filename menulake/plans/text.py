"""Names, addresses, quotes, lines, links and content checks on text."""

from __future__ import annotations

from menulake.plans.dialect import Dialect, plan

# Kind words that a comparable name leaves out, delivery platforms, words of ads.
KINDS = "restaurant|cafe|bistro|brasserie|supplier"
PLATFORMS = ("spam-farm.example.org", "cheap-pills.example.com", "free-bets.example.com")


def folded(d: Dialect, x: str) -> str:
    """Lower case without the accents of western European letters, other characters as spaces."""
    plain = f"translate(lower({x}), 'áàâäãåçéèêëíìîïñóòôöõúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"
    return f"trim({d.gsub(plain, '[^a-z0-9]+', ' ')})"


@plan
def name_keys(d: Dialect) -> str:
    """Comparable name: kind words at the front dropped, all of them kept if nothing else is left."""
    key = folded(d, "replace(s_name, '&', ' en ')")
    short = d.gsub(key, f"^(({KINDS}) )+", "")
    return f"SELECT CAST(s_suppkey AS BIGINT) AS id, {key} AS name_key, CASE WHEN {short} = '' THEN {key} ELSE {short} END AS comparable, {d.join(d.sort(d.keep(d.words(key, ' '), 'w', f'NOT {d.matches(chr(119), f'^({KINDS})$')}')), ' ')} AS core FROM supplier"


@plan
def likely_same_name(d: Dialect) -> str:
    """Equal or one contains the other; unknown where either is."""
    return "SELECT CAST(s_suppkey AS BIGINT) AS id, CASE WHEN s_name IS NULL OR c_name IS NULL THEN NULL ELSE contains(lower(s_name), substr(lower(c_name), 10, 9)) OR contains(lower(c_name), substr(lower(s_name), 10, 9)) END AS same FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey * 2"


@plan
def phone_address_url(d: Dialect) -> str:
    """Dutch phone to +31 and nine digits, white space and postcode of an address, lower-case host."""
    digits = d.gsub("phone", "[^0-9+]", "")
    nine = d.extract(digits, "^(0|[+]31|0031)([1-9][0-9]{8})$", 2)
    host = d.extract("website", "^[A-Za-z]+://([^/]+)", 1)
    return f"""SELECT candidate_id, CASE WHEN {nine} <> '' THEN concat('+31', {nine}) END AS phone, {d.gsub('trim(address)', ' +', ' ')} AS address, upper({d.extract('address', '([0-9]{4} ?[a-zA-Z]{2})$', 1)}) AS postcode,
        CASE WHEN website IS NOT NULL THEN concat('https://', lower({host}), substr(website, length({host}) + 9)) END AS website FROM candidates"""


@plan
def field_confidence(d: Dialect) -> str:
    return "SELECT candidate_id, CASE WHEN phone IS NOT NULL AND website IS NOT NULL THEN 'hoog' WHEN phone IS NOT NULL OR website IS NOT NULL THEN 'middel' ELSE 'laag' END AS confidence FROM candidates"


@plan
def context_status(d: Dialect) -> str:
    """A contradiction anywhere is a conflict; else one agreement is enough."""
    return "SELECT CAST(o_custkey AS BIGINT) AS id, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'conflict' WHEN bool_or(o_orderstatus = 'O') THEN 'consistent' ELSE 'unverified' END AS status FROM orders GROUP BY o_custkey"


@plan
def suggestion(d: Dialect) -> str:
    return "SELECT candidate_id, CASE WHEN phone IS NULL AND website IS NULL THEN 'no_data' WHEN address IS NULL THEN 'new' WHEN phone IS NOT NULL THEN 'match' ELSE 'needs_review' END AS status FROM candidates"


@plan
def url_canonical(d: Dialect) -> str:
    return f"SELECT page_id, host, concat('https://', host, path) AS canonical, concat(host, {d.gsub('path', '/+$', '')}) AS page_key, {d.matches('path', '^/(en|fr)/')} AS hint FROM page_urls"


@plan
def url_precheck(d: Dialect) -> str:
    """Each line ok, invalid, or a duplicate of an earlier line."""
    return f"""SELECT page_id, CASE WHEN host = '' THEN 'invalid' WHEN first_page < page_id THEN 'duplicate' ELSE 'ok' END AS verdict, first_page FROM (SELECT page_id, host, CAST(min(page_id) OVER (PARTITION BY host, {d.gsub('path', '[.]html$', '')}) AS BIGINT) AS first_page FROM page_urls) t"""


@plan
def platform_block(d: Dialect) -> str:
    """Hosts of a block list and their subdomains."""
    blocked = " OR ".join(f"host = '{p}' OR host LIKE '%.{p}'" for p in PLATFORMS)
    return f"SELECT page_id, {blocked} AS blocked FROM page_urls"


@plan
def html_links(d: Dialect) -> str:
    return "SELECT page_id, CAST(nr AS BIGINT) AS nr, href, label FROM links"


@plan
def same_host_links(d: Dialect) -> str:
    """Links of a page to its own host, the first of equal ones, five at most."""
    return """SELECT page_id, href, CAST(pos AS BIGINT) AS pos FROM (SELECT page_id, href, row_number() OVER (PARTITION BY page_id ORDER BY first_nr) AS pos FROM (SELECT page_id, href, min(nr) AS first_nr FROM links WHERE href LIKE '/%' GROUP BY page_id, href) u) t WHERE pos <= 5"""


@plan
def html_headings(d: Dialect) -> str:
    return f"SELECT page_id, trim({d.gsub(d.extract('html', '<h1[^>]*>([^<]*)</h1>', 1), '[ ]+', ' ')}) AS heading FROM pages"


@plan
def link_rank(d: Dialect) -> str:
    """Links scored by words in label and path, the best five of a page."""
    score = "CASE WHEN length(label) > 8 THEN 2 ELSE 0 END + CASE WHEN contains(lower(href), 'th') THEN 1 ELSE 0 END"
    return f"SELECT page_id, CAST(nr AS BIGINT) AS nr, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, nr) AS k FROM (SELECT page_id, nr, {score} AS score FROM links) s) t WHERE k <= 5"


@plan
def text_lines(d: Dialect) -> str:
    return "SELECT doc_id, CAST(nr AS BIGINT) AS nr, CAST(length(line) AS BIGINT) AS n FROM lines"


@plan
def heading_fill(d: Dialect) -> str:
    """The last heading carried to the lines after it; a heading is a short line before a long one."""
    if d.spark:
        carry = "last_value(heading, true) OVER (PARTITION BY doc_id ORDER BY nr ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    else:
        carry = "last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY nr ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""SELECT doc_id, nr, carried FROM (SELECT doc_id, nr, heading, {carry} AS carried FROM (SELECT doc_id, CAST(nr AS BIGINT) AS nr, CASE WHEN length(line) < 60 AND lead(length(line)) OVER (PARTITION BY doc_id ORDER BY nr) >= 60 THEN line END AS heading FROM lines) s) t WHERE heading IS NULL"""


@plan
def content_flags(d: Dialect) -> str:
    flags = {
        "has_url": "https?://|www[.]",
        "has_mail": "[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][a-z]{2,}",
        "has_phone": "[+]?[0-9][0-9 ()-]{7,}[0-9]",
        "has_shout": "[A-Z]{4,} [A-Z]{4,} [A-Z]{4,}",
        "has_clock": "[0-2]?[0-9]:[0-5][0-9]",
        "has_marks": "[!?]{2,}",
    }
    spam = " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END" for w in ("click here", "casino", "free", "license"))
    return "SELECT doc_id, " + ", ".join(f"{d.matches('text', p)} AS {n}" for n, p in flags.items()) + f", ({spam}) >= 2 AS spam FROM documents"


@plan
def edge_trim(d: Dialect) -> str:
    return f"SELECT item_id, {d.gsub(d.gsub('text', '^[ .,;:!?-]+', ''), '[ .,;:!?-]+$', '')} AS trimmed FROM benchmark"


@plan
def strict_dates(d: Dialect) -> str:
    """Dates of the calendar, written as year-month-day with all digits: what is read must be written
    back as it was."""
    read = "CAST(try_to_date(s, 'yyyy-MM-dd') AS STRING)" if d.spark else "CAST(CAST(try_strptime(s, '%Y-%m-%d') AS DATE) AS VARCHAR)"
    return f"SELECT id, s, coalesce({read} = s, false) AS valid FROM (SELECT CAST(o_orderkey AS BIGINT) AS id, concat(CAST(1990 + o_orderkey % 40 AS STRING), '-', lpad(CAST(o_orderkey % 14 AS STRING), 2, '0'), '-', lpad(CAST(o_custkey % 33 AS STRING), 2, '0')) AS s FROM orders) t"


@plan
def bounded_price(d: Dialect) -> str:
    """A printed price as cents up to 500 units, else null."""
    s = "concat('EUR ', CAST(p_partkey % 700 AS STRING), ',', lpad(CAST(p_partkey % 100 AS STRING), 2, '0'))"
    cents = f"CAST({d.extract('s', '([0-9]+),([0-9]{2})', 1)} AS BIGINT) * 100 + CAST({d.extract('s', '([0-9]+),([0-9]{2})', 2)} AS BIGINT)"
    return f"SELECT item, CASE WHEN {cents} <= 50000 THEN {cents} END AS cents FROM (SELECT CAST(p_partkey AS BIGINT) AS item, {s} AS s FROM part) t"

"""Fields of decisions, over texts that are put together from the orders; the same rules in DuckDB's regular expressions.

The texts are SQL that Spark and DuckDB both read, so both see the same; what is in them follows
from the number of the case, so that every rule has its share of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockmill.functions import cascades, origin, rules
from dockmill.functions import extraction as e
from dockmill.sources.cases import CASES_SQL, analogue_cases

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def by_case(n: int, *parts: str) -> str:
    """SQL of the part that a case's number chooses."""
    return f"CASE case_id % {n} " + " ".join(f"WHEN {k} THEN {p}" for k, p in enumerate(parts)) + " ELSE '' END"


NL = "chr(10)"
CODE = by_case(5, "'FCA'", "'AATA'", "'HCA'", "'ARTA'", "'RRTA'")
CITED = f"'[' || year || '] ' || {CODE} || ' ' || case_id"
PLACE = by_case(7, "'Iran'", "'Sri Lanka'", "'Nepal'", "'Fiji'", "'China'", "'Iraq'", "'Papua New Guinea'")
PEOPLE = by_case(7, "'Iranian'", "'Sri Lankan'", "'Nepalese'", "'Fijian'", "'Chinese'", "'Iraqi'", "'Papua New Guinean'")
DAY = "(1 + case_id % 28) || ' ' || CASE case_id % 3 WHEN 0 THEN 'March' WHEN 1 THEN 'May' ELSE 'December' END || ' ' || year"
FILL = "repeat('word ', 120)"
FIELDS = {
    "title": by_case(7, f"'Party ' || case_id || ' v Minister for ' || nature || ' ' || {CITED}", "'Party ' || case_id || ' and Minister for Home Affairs'", f"case_id || ' (Refugee) ' || {CITED}", f"'Lee ' || case_id || ' (Migration) ' || {CITED}", "'Brown; Secretary, Department of ' || nature", f"'Roev Minister for Trade ' || {CITED}"),
    "words": by_case(6, "'jurisdictional error; procedural fairness'", "'well-founded fear; ' || lower(nature)", "'student visa refusal'", "'character test s 501; costs'", "'nan'"),
    "kind": by_case(9, "'Subclass 866 (' || nature || ')'", "'STUDENT  visa'", "'subclass 189'", "'Subclass ' || (200 + case_id % 90)", "'class of visa'", "nature || ' Entry'", "'Character ' || nature || ' cancellation'", "'temporary'"),
    "said": by_case(8, "'Appeal DISMISSED with costs'", f"'Decision set' || {NL} || 'aside'", "'writ of mandamus to issue'", "'appeal incompetent'", "'Orders as below'", "'Something else for ' || nature", "'the matter is remitted'"),
    "cited": f"CASE WHEN case_id % 4 = 0 THEN '' WHEN case_id % 4 = 1 THEN 'no year' ELSE {CITED} END",
    "url": f"'http://example.org/au/' || {CODE} || '/' || year || '/' || case_id || '.html'",
    "body": " || ".join([
        by_case(4, f"'DATE OF JUDGMENT: ' || {DAY} || {NL}", f"'Decision date: ' || {DAY} || {NL}", f"'Heard before us on ' || {DAY} || {NL}"),
        by_case(3, f"'CATCHWORDS: Visa - ' || nature || {NL} || {NL}", f"'Catchwords' || {NL} || nature || ' - ' || country || {NL} || 'LEGISLATION' || {NL}"),
        by_case(5, f"'BEFORE: Member ' || country || {NL}", f"'x Coram: Justice No' || case_id || {NL}", f"'JUDGE: ' || nature || {NL}"),
        by_case(6, f"'ORDER: the appeal of ' || case_id || ' is allowed' || {NL} || ' ' || {NL}", f"'The Tribunal remits the matter of ' || nature || {NL}", f"'The Court dismisses it. Statement made on ' || {DAY} || {NL}"),
        by_case(3, "'under the Migration Act 1958 (Cth) as it was. The Migration Act 1958 applies. '", "'see Migration Regulations 1994 r ' || case_id || '. '"),
        f"'He held a student visa, subclass ' || (500 + case_id % 99) || ', see ' || {CITED}",
    ]),
    "judgment": by_case(8, f"'DECISION:' || {NL} || {NL} || 'The Tribunal remits ' || nature || {NL} || 'x' || {NL} || 'y'", f"'ORDERS' || {NL} || '(1) One ' || case_id || {NL} || '(2) Two' || {NL} || 'rest'", f"'ORDER: the ' || nature || ' matter' || {NL} || {NL} || 'more'", f"'The application of ' || case_id || ' is refused with costs' || {NL} || 'x'", f"'x' || {NL} || 'all of ' || nature || ' must be granted' || {NL}", "'the review is hereby upheld for ' || case_id", f"'the decision under review is varied for ' || country || {NL}"),
    "applied": by_case(8, "'a partner (Class UC) visa of ' || nature", "nature || ' Entry (Class UC) visas'", "'section 501 of ' || nature", "'to grant a Class TU thing to ' || case_id", "'Subclass 457 (Work) of ' || nature", "'a claim of refugees'", "'judicial review'"),
    "headed": by_case(6, f"'CATCHWORDS: MIGRATION - visa of ' || nature || {NL} || 'refused' || {NL} || {NL} || 'rest'", f"'Catchwords' || {NL} || 'No Catchwords' || {NL}", f"'CATCHWORDS: x' || {NL} || {NL} || 'DIVISION:' || {NL} || 'Migration & ' || nature || {NL}", f"'KEY WORDS: ' || country || ' and ' || nature || {NL} || {NL}", f"'CATCHWORDS' || {NL} || 'section 36 of ' || country || {NL} || 'LEGISLATION' || {NL}"),
    "tested": by_case(6, "'under s. 36 of it'", "'the ' || nature || ' character test'", f"'LEGISLATION' || {NL} || {NL} || 'Act s 5 s ' || (40 + case_id % 900) || ' section 65, s 65' || {NL} || 'STATEMENT OF x'", "'a risk of serious harm'", "'s 24 of the Citizenship Act'"),
    "told": by_case(9, f"'Country of Reference: ' || upper({PLACE}) || ' MEMBER: Lee'", f"'He is a citizen of ' || {PLACE} || '.'", f"'an ' || {PEOPLE} || ' national'", "'INTERPRETER: Tamil (Sri Lanka)'", f"'was born in ' || {PLACE}", f"{FILL} || ' fear of harm in ' || {PLACE}", f"'holds a ' || {PLACE} || ' passport'", f"{FILL} || {PLACE} || 'X, not ' || {PLACE}"),
    "appearances": by_case(9, f"'REPRESENTATIVE:' || {NL} || {NL} || 'Ms No' || case_id || ' (MARN: 12) DATE: ' || {DAY}", "'The applicant was self-represented.'", f"'represented by Firm ' || case_id || {NL}", f"'Counsel for the Appellant:' || {NL} || 'Mr ' || nature || {NL}", "'The applicant was not represented'", f"'Migration Agent: Agent ' || case_id || {NL}", f"'Applicant''s Representative: none' || {NL}", f"'appeared for the applicant: Roe ' || case_id || {NL}"),
}
SAID_SQL = f"{CASES_SQL}, d AS (SELECT case_id, year, court, {CODE} AS code, " + ", ".join(f"{sql} AS {name}" for name, sql in FIELDS.items()) + " FROM cases)"


def analogue_decisions(spark, d, *fields: str) -> DataFrame:
    """case_id, year, code and the asked fields of every case; dealt by case while they are narrow, as few bytes of Parquet, one task's share, are many texts."""
    return analogue_cases(spark, d).repartition("case_id").selectExpr("case_id", "year", f"{CODE} AS code", *(f"{FIELDS[name]} AS {name}" for name in fields))


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def first_of(c: str, labels: list[tuple[str, str]], otherwise: str) -> str:
    """SQL of the label of the first pattern that occurs."""
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, {quoted(p)}) THEN {quoted(name)}" for p, name in labels) + f" ELSE {otherwise} END"


def first_group(c: str, patterns: list[str], group: int = 1) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, {quoted(p)}) THEN trim(regexp_extract({c}, {quoted(p)}, {group}))" for p in patterns) + " ELSE '' END"


PAIR = [*e.PARTIES, None, e.JOINED_V]


def _party(group: int) -> str:
    alone = f"WHEN regexp_matches(title, {quoted(e.SURNAME_ONLY)}) AND NOT regexp_full_match(replace(trim(regexp_extract(title, {quoted(e.SURNAME_ONLY)}, 1)), ' ', ''), '\\d+') THEN " + (f"trim(regexp_extract(title, {quoted(e.SURNAME_ONLY)}, 1))" if group == 1 else "''")
    return "CASE " + " ".join(alone if p is None else f"WHEN regexp_matches(title, {quoted(p)}) THEN trim(regexp_extract(title, {quoted(p)}, {group}))" for p in PAIR) + " ELSE '' END"


@query(f"WITH {SAID_SQL} SELECT case_id, {_party(1)} AS applicant, {_party(2)} AS respondent FROM d")
def title_parties(spark, d):
    return analogue_decisions(spark, d, "title").select("case_id", e.parties(F.col("title")).alias("p")).select("case_id", "p.*")


HEARD = "CASE " + " ".join(f"WHEN regexp_matches({'body' if n is None else f'left(body, {n})'}, {quoted(p)}) THEN regexp_extract({'body' if n is None else f'left(body, {n})'}, {quoted(p)}, 1)" for n, p in e.HEARING) + " ELSE '' END"


@query(f"WITH {SAID_SQL} SELECT case_id, {first_group('body', e.DATES)} AS decided, {HEARD} AS heard FROM d")
def decision_dates(spark, d):
    return analogue_decisions(spark, d, "body").select("case_id", e.decision_date(F.col("body")).alias("decided"), e.hearing_date(F.col("body")).alias("heard"))


BLOCK = rf"(?is)CATCHWORDS[:\s]*\n?(.*?)(?:{e.CATCHWORDS_END})"
ORDERED = r"(?is)(?:DECISION|ORDER|ORDERS|THE COURT ORDERS)[:\s]*\n?(?:.*?)(?:\n\s*\n)"


@query(f"""WITH {SAID_SQL}
SELECT case_id, regexp_extract(body, {quoted(e.CITATION)}, 0) AS citation, trim(regexp_extract(body, {quoted(e.VISA)}, 1)) AS visa_type,
array_to_string(regexp_extract_all(body, {quoted(e.LEGISLATION[0])}, 1)[:2] || regexp_extract_all(body, {quoted(e.LEGISLATION[1])}, 1)[:2], '; ')[:300] AS legislation,
regexp_extract(body, '(?i)subclass\\s+(\\d{{3}})', 1) AS subclass, trim(regexp_extract(body, {quoted(BLOCK)}, 1)) AS catchwords, {first_group('body', e.JUDGES)} AS judges,
trim({first_group('body', [ORDERED, e.DECIDED], 0)}, ' ' || {NL}) AS outcome FROM d""")
def decision_fields(spark, d):
    body, none = F.col("body"), F.lit("")
    return analogue_decisions(spark, d, "body").select(
        "case_id", e.citation(body).alias("citation"), e.visa_type(body).alias("visa_type"), e.legislation(body).alias("legislation"), e.subclass_number(none, none, body).alias("subclass"),
        e.catchwords(body).alias("catchwords"), e.judges(body).alias("judges"), e.outcome_text(body).alias("outcome"),
    )


USUAL = "CASE WHEN code IN ('FCA', 'HCA') THEN 'Judicial review' WHEN code IN ('AATA', 'ARTA') THEN 'Merits review' ELSE 'Migration (general)' END"
NAMED = "lower(CASE WHEN words IN ('', 'nan') THEN title ELSE words END)"
MENTIONED = "[" + ", ".join(f"CASE WHEN regexp_matches(s2, {quoted(p)}) THEN {quoted(name)} END" for p, name in e.CONCEPTS) + "]"


@query(f"""WITH {SAID_SQL}, s AS (SELECT case_id, code, lower(concat_ws(' ', nullif(nullif(words, ''), 'nan'), nullif(title, ''))) AS s1, {NAMED} AS s2 FROM d)
SELECT case_id, {first_of('s1', e.NATURES, USUAL)} AS nature, coalesce(array_to_string({MENTIONED}, '; '), '') AS concepts FROM s""")
def inferred_fields(spark, d):
    rows = analogue_decisions(spark, d, "words", "title")
    return rows.select("case_id", e.inferred_nature(F.col("code"), F.col("words"), F.col("title")).alias("nature"), F.array_join(e.inferred_concepts(F.col("words"), F.col("title")), "; ").alias("concepts"))


STANDARD = "CASE " + " ".join(f"WHEN contains(low, {quoted(p)}) THEN {quoted(name)}" for p, name in e.STANDARD_OUTCOMES)


@query(f"""WITH {SAID_SQL}, s AS (SELECT case_id, said, trim(regexp_replace(said, '\\s+', ' ', 'g')) AS one, lower(trim(regexp_replace(said, '\\s+', ' ', 'g'))) AS low FROM d)
SELECT case_id, {STANDARD} WHEN contains(low, 'writ') AND regexp_matches(low, 'certiorari|mandamus|prohibition') THEN 'Allowed' WHEN contains(low, 'incompetent') OR contains(low, 'not competent') THEN 'Dismissed'
WHEN regexp_matches(low, '^(decision|order|procedural|tribunal|the applicat|protection)') THEN 'Unknown' ELSE left(one, 80) END AS label FROM s""")
def standard_outcomes(spark, d):
    return analogue_decisions(spark, d, "said").select("case_id", e.standard_outcome(F.col("said")).alias("label"))


LOW = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"
VISA_REST = "CASE WHEN regexp_matches(k, '^subclass (\\d+)') THEN 'Subclass ' || regexp_extract(k, '^subclass (\\d+)', 1) || ' visa' WHEN k = 'class of visa' THEN 'Migration (general)' ELSE trim(kind) END"
TITLED = "array_to_string([upper(x[1]) || lower(x[2:]) FOR x IN string_split(trim(kind), ' ')], ' ')"


@query(f"""WITH {SAID_SQL}, s AS (SELECT *, {LOW.format('kind')} AS k FROM d)
SELECT case_id, CASE WHEN k = '' THEN kind ELSE {first_of('k', e.STANDARD_VISAS, VISA_REST)} END AS visa, CASE WHEN k = '' THEN kind WHEN contains(k, '(') THEN 'Subclass 866 (' || regexp_extract(kind, '\\((.)', 1) || lower(regexp_extract(kind, '\\(.(.*)$', 1)) ELSE {first_of('k', e.STANDARD_NATURES, TITLED)} END AS nature FROM s""")
def standard_kinds(spark, d):
    return analogue_decisions(spark, d, "kind").select("case_id", e.standard_visa(F.col("kind")).alias("visa"), e.standard_nature(F.col("kind")).alias("nature"))


@query(f"""WITH {SAID_SQL}, s AS (SELECT case_id, year AS known, CASE WHEN case_id % 7 < 3 THEN 0 ELSE year END AS year, cited, url FROM d)
SELECT case_id, CASE WHEN year <> 0 THEN year WHEN cited = '' THEN CAST(regexp_extract(url, '/(\\d{{4}})/', 1) AS INTEGER) WHEN regexp_matches(cited, '\\[\\d{{4}}\\]') THEN CAST(regexp_extract(cited, '\\[(\\d{{4}})\\]', 1) AS INTEGER) ELSE 0 END AS year FROM s""")
def repaired_years(spark, d):
    rows = analogue_decisions(spark, d, "cited", "url").withColumn("year", F.when(F.col("case_id") % 7 < 3, 0).otherwise(F.col("year")))
    return rows.select("case_id", e.repaired_year(F.col("year"), F.col("cited"), F.col("url")).alias("year"))


ANY = "(Iran|Sri Lanka|Nepal|Fiji|China|Iraq|Papua New Guinea)"
PEOPLES = "CASE " + " ".join(f"WHEN contains(told, '{people} national') THEN '{place}'" for people, place in (("Iranian", "Iran"), ("Sri Lankan", "Sri Lanka"), ("Nepalese", "Nepal"), ("Fijian", "Fiji"), ("Chinese", "China"), ("Iraqi", "Iraq"), ("Papua New Guinean", "Papua New Guinea"))) + " END"
TELLING = [f"citizen of {ANY}", f"born in {ANY}", f"{ANY} passport", f"harm in {ANY}"]


@query(f"""WITH {SAID_SQL} SELECT case_id, CASE WHEN starts_with(told, 'Country of') THEN list_filter(['Iran', 'Sri Lanka', 'Nepal', 'Fiji', 'China', 'Iraq', 'Papua New Guinea'], lambda x: contains(told, upper(x) || ' MEMBER'))[1]
WHEN contains(told, 'INTERPRETER') THEN 'Sri Lanka' WHEN ({PEOPLES}) IS NOT NULL THEN {PEOPLES} {' '.join(f"WHEN regexp_matches(told, '{p}') THEN regexp_extract(told, '{p}', 1)" for p in TELLING)}
ELSE regexp_extract(told[501:], '\\b{ANY}\\b', 1) END AS country FROM d""")
def countries_of_origin(spark, d):
    return analogue_decisions(spark, d, "told").select("case_id", origin.country_of_origin(F.col("told")).alias("country"))


@query(f"""WITH {SAID_SQL}, s AS (SELECT case_id, appearances AS a FROM d) SELECT case_id,
CASE WHEN a = '' THEN '' WHEN regexp_matches(a, '(?i)self-represented|not represented|none') THEN 'No' ELSE 'Yes' END AS represented,
CASE WHEN starts_with(a, 'REPRESENTATIVE') THEN trim(regexp_extract(a, ':\\n\\n(.*?) \\(MARN', 1)) WHEN regexp_matches(a, 'self-represented|not represented|none') THEN '' ELSE trim(regexp_extract(a, '(?:represented by|Agent:|Appellant:\\n|applicant:) ?([^\\n]+)', 1)) END AS representative FROM s""")
def representations(spark, d):
    rows = analogue_decisions(spark, d, "appearances").select("case_id", rules.represented_by(F.col("appearances")).alias("r"))
    return rows.select("case_id", "r.represented", "r.representative")


OUTCOME_RULES = [r"(?i)DECISION:\s*The Tribunal[^\n]*(?:\n[^\n]*){0,3}", r"(?i)The decision under review is \w+[^\n]*", r"(?i)ORDERS?\s*\n(?:\(\d+\)[^\n]*\n?){1,6}", r"(?is)(?:ORDERS?|THE COURT ORDERS)[:\s]*\n?(.*?)(?:\n\s*\n)",
                 r"(?i)(?:The )?application[^\n]*(?:is|be|must be)\s+(?:dismissed|refused|allowed|granted)[^\n]*", r"(?i)[^\n]*must be (?:dismissed|refused|allowed|granted)[^\n]*", r"(?i)(?:review|appeal|application)\s+(?:should be|is hereby|is|be)\s+(?:affirmed|dismissed|allowed|refused|remitted|set aside|upheld)[^\n]*"]
OUTCOME_TOLD = "CASE " + " ".join(f"WHEN regexp_matches(judgment, {quoted(p)}) THEN trim(regexp_extract(judgment, {quoted(p)}, 0), ' ' || {NL})" for p in OUTCOME_RULES) + " ELSE '' END"
CATCHWORDS_TOLD = "CASE " + " ".join(f"WHEN length(trim(regexp_extract(headed, {quoted(p)}, 1))) > 5 THEN trim(regexp_extract(headed, {quoted(p)}, 1))" for p in (r"(?is)CATCHWORDS[:\s]*\n?(.*?)(?:\n\s*\n|\nLEGISLATION|\nCASES|\nORDER|\nAPPLICANT)", r"(?is)KEY WORDS?[:\s]*\n?(.*?)(?:\n\s*\n)", r"(?i)DIVISION:\s*\n?\s*(Migration[^\n]*)")) + " ELSE '' END"
REASON = r"(?is)CATCHWORDS?\s*[:\n]+\s*(.+?)\n\s*(?:LEGISLATION|STATEMENT\s+OF|DECISION\s+AND\s+REASONS|$)"
TEST_RULES = [(r"(?i)\bs\.?\s*36\b", "s.36 refugee test"), (r"(?i)\bs\.?\s*24\b.*citizenship", "s.24 citizenship refusal"), (r"(?i)\brisk\s+(?:of|to)\s+(?:significant|serious)\s+harm\b", "complementary protection"), (r"(?i)\bcharacter\s+test\b", "character test")]
TESTED = first_of("tested", TEST_RULES, "CASE WHEN starts_with(tested, 'LEGISLATION') THEN CASE regexp_extract(tested, 's 5 s (\\d+)', 1) WHEN '501' THEN 's.501 character test' WHEN '499' THEN 's.499 ministerial direction' WHEN '417' THEN 's.417 ministerial intervention' WHEN '351' THEN 's.351 ministerial intervention (MRTA)' ELSE 's.65' END ELSE '' END")


@query(f"""WITH {SAID_SQL} SELECT case_id, {OUTCOME_TOLD} AS outcome,
CASE case_id % 8 WHEN 0 THEN regexp_extract(applied, 'partner \\(Class UC\\) visa', 0) WHEN 1 THEN regexp_extract(applied, '^(.*) Entry', 1) || ' Entry (Class UC)' WHEN 2 THEN 'Character cancellation (s.501)' WHEN 3 THEN regexp_extract(applied, 'Class TU[^\\n]*', 0)
 WHEN 4 THEN 'Subclass 457 (W)' ELSE CASE WHEN contains(title, '(Migration)') THEN 'Migration (general)' WHEN contains(title, '(Refugee)') OR case_id % 8 = 5 THEN 'Refugee/Protection' WHEN case_id % 8 = 6 THEN 'Judicial review (migration)' ELSE '' END END AS visa,
CASE WHEN contains(headed, 'No Catchwords') THEN 'No Catchwords' ELSE {CATCHWORDS_TOLD} END AS catchwords,
regexp_replace(trim(regexp_replace(regexp_extract(headed, {quoted(REASON)}, 1), '\\s+', ' ', 'g')), '(?i)^(?:MIGRATION|IMMIGRATION)\\s*[–-]\\s*', '') AS reason, {TESTED} AS legal_test FROM d""")
def decision_cascades(spark, d):
    rows = analogue_decisions(spark, d, "judgment", "applied", "title", "headed", "tested")
    return rows.select(
        "case_id", cascades.outcome_of(F.col("judgment")).alias("outcome"), cascades.visa_of(F.col("applied"), F.col("title")).alias("visa"), cascades.catchwords_of(F.col("headed")).alias("catchwords"),
        cascades.reason_of(F.col("headed")).alias("reason"), cascades.legal_test_of(F.col("tested")).alias("legal_test"),
    )

"""Fields from the text of a decision: ordered rules, of which the first that fits decides. All are Column functions.

Every function takes null as empty text and gives an empty string (or array) where no rule fits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from dockmill.functions.cases import text

# The patterns and labels below have to be these for equal results.
MONTHS = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
DAY = r"(\d{1,2}\s+" + MONTHS + r"\s+\d{4})"
PARTIES = [
    r"(?i)^(.+?)\s+v\s+(.+?)(?:\s*\[\d{4}\]|\s*$)",
    r"(?i)^(.+?)\s+and\s+(Minister.+?)(?:\s*\[\d{4}\]|\s*$)",
    r"(?i)^(.+?)\s+and\s+((?:Migrations?\s+Agents?\s+Registration\s+Authority|Secretary,?\s+Department.+?|Department\s+of.+?|Migration\s+Review\s+Tribunal|Military\s+Rehabilitation.+?))(?:\s*\(|\s*\[\d{4}\]|\s*$)",
    r"(?i)^(.+?);\s*(Secretary,?\s+Department.+?)(?:\s+and\s*\(|\s*\[\d{4}\]|\s*$)",
]
SURNAME_ONLY = r"(?i)^(.+?)\s+\((?:Migration|Refugee|Character|Citizenship)\)\s*\["
JOINED_V = r"(?i)^(.+?)v\s+(Minister.+?)(?:\s*\[\d{4}\]|\s*$)"
DATES = [
    r"(?i)(?:DATE OF (?:ORDER|DECISION|HEARING|JUDGMENT))[:\s]+(\d{1,2}\s+\w+\s+\d{4})",
    r"(?i)(?:Decision date|Judgment date|Date)[:\s]+(\d{1,2}\s+\w+\s+\d{4})",
    "(?i)" + DAY,
]
CATCHWORDS = "(?i)CATCHWORDS"
CATCHWORDS_END = r"\n\s*\n|\nLEGISLATION|\nCASES(?:\s+CITED)?|\nORDER"
JUDGES = [r"(?im)^(?:BEFORE|JUDGE|JUSTICE|TRIBUNAL MEMBER)[:\s]+([^\n]+)", r"(?i)(?:Before|Coram)[:\s]+([^\n]+)"]
CITATION = r"\[\d{4}\]\s+(?:AATA|ARTA|FCA|FCCA|FMCA|HCA|FedCFamC2G|RRTA|MRTA)\s+\d+"
ORDERS = "(?i)DECISION|ORDER|THE COURT ORDERS"
DECIDED = r"(?i)(?:The Tribunal|The Court)\s+(?:affirms|remits|sets aside|dismisses|allows|refuses|grants)[^\n]*"
VISA = r"(?i)((?:protection|skilled|partner|student|visitor|bridging|temporary|permanent|subclass\s+\d+)\s*visa)"
LEGISLATION = [r"(?i)(Migration Act 1958[^.]*)", r"(?i)(Migration Regulations 1994[^.]*)"]
#: Patterns and how many characters from the beginning they look at; None stands for all.
HEARING = [
    (None, r"(?i)Date\s+of\s+(?:hearing|hearing\s+and\s+decision)[:\s]+" + DAY),
    (None, r"(?i)(?:heard|hearing)[^\n]{0,40}?" + DAY),
    (3000, r"(?i)DATE\s*:\s*\n\s*\n?\s*" + DAY),
    (5000, r"(?i)Statement\s+made\s+on\s+" + DAY),
    (5000, r"(?i)(?:decision|decided|delivered|handed\s+down)\s+(?:on\s+)?" + DAY),
    (5000, r"(?i)Date\s+of\s+(?:judgment|decision|orders?)\s*:\s*\n?\s*" + DAY),
    (5000, r"(?i)(?:^|\n)\s*(?:Judgment|Decision|Delivered\s+on)\s*:\s*\n?\s*" + DAY),
    (5000, r"(?i)Date\s+heard\s*:?\s*" + DAY),
]
STANDARD_OUTCOMES = [
    ("dismiss", "Dismissed"), ("affirm", "Affirmed"), ("set aside", "Set aside"), ("substitut", "Set aside"), ("remit", "Remitted"), ("quash", "Quashed"), ("uphold", "Upheld"), ("upheld", "Upheld"),
    ("allow", "Allowed"), ("grant", "Granted"), ("refuse", "Refused"), ("withdraw", "Withdrawn"), ("discontinu", "Discontinued"), ("adjourn", "Adjourned"), ("consent", "By consent"),
    ("struck out", "Struck out"), ("strike out", "Struck out"), ("the decision under review is taken to be", "Affirmed"), ("no jurisdiction", "No jurisdiction"), ("does not have jurisdiction", "No jurisdiction"),
]
STANDARD_NATURES = [
    (r"judicial review", "Judicial review"),
    (r"merits review", "Merits review"),
    (r"protection.*visa|refugee.*protection|class xa", "Protection visa"),
    (r"refugee|well.founded fear|complementary protection|non.refoulement", "Refugee assessment"),
    (r"cancel", "Visa cancellation"),
    (r"refus", "Visa refusal"),
    (r"appeal", "Appeal"),
    (r"character.*test|s\.?\s*501|section 501", "Character test (s.501)"),
    (r"detention|habeas|unlawful.*detent", "Detention challenge"),
    (r"student.*visa", "Student visa application"),
    (r"partner|spouse|family.*reunion", "Partner/Family visa"),
    (r"skilled|employer.*nomin|subclass.*(186|187|189|457|482)", "Skilled migration"),
    (r"bridging.*visa", "Bridging visa"),
    (r"citizenship|naturalisation", "Citizenship"),
    (r"migration.*review|migration.*application|visa.*application.*review", "Migration review"),
    (r"administrat.*review", "Administrative review"),
    (r"^migration\b", "Migration (general)"),
]
STANDARD_VISAS = [
    (r"protection", "Protection visa"),
    (r"refugee", "Protection visa"),
    (r"class xa", "Protection visa"),
    (r"subclass 866", "Protection visa"),
    (r"subclass 785", "Protection visa"),
    (r"subclass 790", "Protection visa"),
    (r"student", "Student visa"),
    (r"subclass 500\b", "Student visa"),
    (r"subclass 57[0-9]", "Student visa"),
    (r"subclass 457", "Temporary Work (Skilled) visa"),
    (r"subclass 482", "Temporary Skill Shortage visa"),
    (r"subclass 186", "Employer Nomination Scheme visa"),
    (r"subclass 187", "Regional Sponsored Migration visa"),
    (r"subclass 189", "Skilled Independent visa"),
    (r"subclass 190", "Skilled Nominated visa"),
    (r"subclass 491", "Skilled Work Regional visa"),
    (r"skilled", "Skilled visa"),
    (r"partner", "Partner visa"),
    (r"spouse", "Partner visa"),
    (r"subclass 309", "Partner visa"),
    (r"subclass 820", "Partner visa"),
    (r"subclass 801", "Partner visa"),
    (r"subclass 300", "Prospective Marriage visa"),
    (r"subclass 101", "Child visa"),
    (r"subclass 117", "Orphan Relative visa"),
    (r"subclass 143", "Contributory Parent visa"),
    (r"subclass 802", "Child visa"),
    (r"subclass 836", "Contributory Parent visa"),
    (r"visitor", "Visitor visa"),
    (r"subclass 600", "Visitor visa"),
    (r"subclass 601", "Electronic Travel Authority"),
    (r"class fa", "Visitor visa"),
    (r"bridging", "Bridging visa"),
    (r"subclass 050", "Bridging visa"),
    (r"subclass 051", "Bridging visa"),
    (r"subclass 408", "Temporary Activity visa"),
    (r"subclass 417", "Working Holiday visa"),
    (r"subclass 462", "Work and Holiday visa"),
    (r"subclass 485", "Temporary Graduate visa"),
    (r"subclass 444", "Special Category visa (NZ)"),
    (r"class tu", "Temporary visa"),
    (r"citizenship", "Citizenship"),
    (r"character.*cancel|s\.?\s*501|section 501", "Character cancellation (s.501)"),
    (r"character", "Character cancellation (s.501)"),
    (r"judicial review \(migration\)", "Judicial review (migration)"),
    (r"permanent", "Permanent visa"),
    (r"temporary", "Temporary visa"),
    (r"migration \(general\)", "Migration (general)"),
    (r"^migration$", "Migration (general)"),
]
NATURES = [
    (r"judicial review|jurisdictional error|unreasonableness", "Judicial review"),
    (r"merits review|tribunal.*affirm|tribunal.*set aside", "Merits review"),
    (r"protection.*visa|refugee|well.founded fear|complementary protection|non.refoulement|persecution|serious harm", "Protection visa"),
    (r"cancel.*visa|visa.*cancel|s\.?\s*501|character.*test|character.*ground", "Visa cancellation"),
    (r"refus.*visa|visa.*refus", "Visa refusal"),
    (r"appeal|appellant", "Appeal"),
    (r"detention|habeas|unlawful.*detent", "Detention challenge"),
    (r"student.*visa|subclass 500|subclass 57[0-9]", "Student visa application"),
    (r"partner.*visa|spouse|subclass (309|820|801)", "Partner/Family visa"),
    (r"skilled|employer.*nomin|subclass.*(186|187|189|457|482)", "Skilled migration"),
    (r"bridging.*visa|subclass 050", "Bridging visa"),
    (r"citizenship|naturalisation", "Citizenship"),
]
CONCEPTS = [
    (r"jurisdictional error", "Jurisdictional error"),
    (r"procedural fairness|natural justice", "Procedural fairness"),
    (r"unreasonableness|illogical|irrational", "Unreasonableness"),
    (r"credibility", "Credibility assessment"),
    (r"well.founded fear", "Well-founded fear of persecution"),
    (r"complementary protection", "Complementary protection"),
    (r"serious harm", "Serious harm"),
    (r"particular social group", "Particular social group"),
    (r"s\.?\s*501|character.*test|character.*ground", "Character test (s.501)"),
    (r"visa.*cancel", "Visa cancellation"),
    (r"time.*limit|out of time|extension of time", "Time limitation"),
    (r"no.case.*submission|s\.?\s*424a|s\.?\s*425", "Tribunal hearing obligations"),
    (r"minister.*interven|s\.?\s*417|s\.?\s*48b", "Ministerial intervention"),
    (r"country.*information|dfat|country.*report", "Country information"),
    (r"migration agent|omara|mara", "Migration agent issues"),
    (r"public interest criteria|pic 4020|pic 4014", "Public interest criteria"),
    (r"genuine.*relationship|genuine.*spouse", "Genuine relationship"),
    (r"health.*requirement|medical", "Health requirements"),
    (r"english.*language|ielts", "English language requirements"),
    (r"merits review", "Merits review"),
    (r"costs|indemnity", "Costs"),
]
# End of fixed values.


#: What str.strip() takes off; Spark's trim takes blanks alone.
WHITE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(c: Column) -> Column:
    """Without white space at both ends, in one pass."""
    return F.btrim(c, F.lit(WHITE))


def body_of(c: Column) -> Column:
    """The text with blanks for NUL signs; null counts as empty."""
    return F.replace(text(c), F.lit("\x00"), F.lit(" "))


def first_match(c: Column, patterns: list[str], group: int = 1) -> Column:
    """The group of the first pattern that occurs, without white space around it."""
    said = body_of(c)
    found = [F.when(said.rlike(p), stripped(F.regexp_extract(said, p, group))) for p in patterns]
    return F.coalesce(*found, F.lit(""))


def behind(said: Column, heading: str) -> Column:
    """What follows the first heading, null without one. Blocks are looked for there once: where the first heading's has no end, no later one's has."""
    return F.get(F.split(said, heading, 2), F.lit(1))


def first_label(c: Column, rules: list[tuple[str, str]], otherwise: Column) -> Column:
    """The label of the first rule whose pattern occurs."""
    return reduce(lambda rest, r: F.when(c.rlike(r[0]), r[1]).otherwise(rest), reversed(rules), otherwise)


def parties(title: Column) -> Column:
    """(applicant, respondent) of a case title; a surname alone, unless it is a number, has no respondent."""
    said = F.trim(text(title))
    pair = lambda p: F.struct(F.trim(F.regexp_extract(said, p, 1)).alias("applicant"), F.trim(F.regexp_extract(said, p, 2)).alias("respondent"))
    rules = [F.when(said.rlike(p), pair(p)) for p in PARTIES]
    alone = F.trim(F.regexp_extract(said, SURNAME_ONLY, 1))
    rules.append(F.when(said.rlike(SURNAME_ONLY) & ~F.replace(alone, F.lit(" "), F.lit("")).rlike(r"^\d+$"), F.struct(alone.alias("applicant"), F.lit("").alias("respondent"))))
    rules.append(F.when(said.rlike(JOINED_V), pair(JOINED_V)))
    return F.coalesce(*rules, F.struct(F.lit("").alias("applicant"), F.lit("").alias("respondent")))


def decision_date(c: Column) -> Column:
    return first_match(c, DATES)


def hearing_date(c: Column) -> Column:
    """The date that the text names as heard, else the one its beginning names as made or handed down."""
    said = text(c)
    parts = [(said if n is None else F.left(said, F.lit(n)), p) for n, p in HEARING]
    found = [F.when(part.rlike(p), F.regexp_extract(part, p, 1)) for part, p in parts]
    return F.coalesce(*found, F.lit(""))


def catchwords(c: Column) -> Column:
    """What follows the heading up to a blank line or the next heading, cut to 500 signs."""
    block = F.regexp_extract(behind(body_of(c), CATCHWORDS), rf"(?is)^[:\s]*+(.*?)(?:{CATCHWORDS_END})", 1)
    return F.coalesce(F.substring(stripped(block), 1, 500), F.lit(""))


def judges(c: Column) -> Column:
    """The rest of the line behind a label that begins a line, else behind one anywhere."""
    return first_match(c, JUDGES)


def citation(c: Column) -> Column:
    return F.regexp_extract(body_of(c), CITATION, 0)


def outcome_text(c: Column) -> Column:
    """The first block of orders with its heading up to a blank line, else the sentence that decides; cut to 300 signs."""
    said = body_of(c)
    heading, rest = F.regexp_extract(said, ORDERS, 0), behind(said, ORDERS)
    block = F.regexp_extract(rest, r"(?s)^[:\s]*+.*?\n\s*\n", 0)
    signs = F.regexp_extract(rest, r"^[:\s]*", 0)  # a blank line right behind the heading may be the only one
    found = F.when(block != "", F.concat(heading, block)).when(signs.rlike(r"\n\s*\n"), F.concat(heading, signs))
    return F.substring(F.coalesce(stripped(found), first_match(c, [DECIDED], 0)), 1, 300)


def visa_type(c: Column) -> Column:
    return first_match(c, [VISA])


def legislation(c: Column) -> Column:
    """The first two mentions of each act, joined."""
    found = F.concat(*(F.slice(F.regexp_extract_all(text(c), F.lit(p), F.lit(1)), 1, 2) for p in LEGISLATION))
    return F.substring(F.array_join(found, "; "), 1, 300)


def standard_outcome(c: Column) -> Column:
    """A standard label; what only heads a document is Unknown, and any other text stays, cut to 80 signs."""
    said = F.trim(F.regexp_replace(text(c), r"\s+", " "))
    low = F.lower(said)
    writ = low.contains("writ") & low.rlike("certiorari|mandamus|prohibition")
    rest = F.when(writ, "Allowed").when(low.contains("incompetent") | low.contains("not competent"), "Dismissed").when(low.rlike("^(decision|order|procedural|tribunal|the applicat|protection)"), "Unknown").otherwise(F.substring(said, 1, 80))
    label = reduce(lambda rest, r: F.when(low.contains(r[0]), r[1]).otherwise(rest), reversed(STANDARD_OUTCOMES), rest)
    return F.when((said == "") | (said == "nan"), text(c)).otherwise(label)


def _plain(c: Column) -> Column:
    """Lower case, runs of white space as one blank."""
    return F.lower(F.regexp_replace(stripped(text(c)), r"\s+", " "))


def standard_visa(c: Column) -> Column:
    """The standard name of a visa; one of an unknown subclass is named by its number, any other text stays."""
    said = _plain(c)
    number = F.regexp_extract(said, r"^subclass (\d+)", 1)
    rest = F.when(number != "", F.concat(F.lit("Subclass "), number, F.lit(" visa"))).when(said == "class of visa", "Migration (general)").otherwise(stripped(text(c)))
    return F.when(said.isin("", "nan"), text(c)).otherwise(first_label(said, STANDARD_VISAS, rest))


def title_case(c: Column) -> Column:
    """A capital wherever a letter follows none, all others small."""
    return F.array_join(F.transform(F.split(F.lower(c), r"(?<!\p{L})(?=\p{L})"), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 30))), "")


def standard_nature(c: Column) -> Column:
    """The standard name of a case's nature; an unknown one in title case."""
    said = _plain(c)
    return F.when(said.isin("", "nan"), text(c)).otherwise(first_label(said, STANDARD_NATURES, title_case(stripped(text(c)))))


def inferred_nature(court: Column, *texts: Column) -> Column:
    """The nature that the texts tell, else the usual one of the court."""
    said = F.lower(F.concat_ws(" ", *(F.nullif(F.nullif(F.trim(text(t)), F.lit("")), F.lit("nan")) for t in texts)))
    code = F.upper(text(court))
    usual = F.when(code.isin("FCA", "FCCA", "HCA"), "Judicial review").when(code.isin("AATA", "ARTA"), "Merits review").otherwise("Migration (general)")
    return first_label(said, NATURES, usual)


def inferred_concepts(words: Column, title: Column) -> Column:
    """Concepts that the catchwords (else the title) name, in the order of the rules."""
    has = ~F.trim(text(words)).isin("", "nan")
    said = F.lower(F.when(has, text(words)).otherwise(text(title)))
    return F.array_compact(F.array(*(F.when(said.rlike(p), name) for p, name in CONCEPTS)))


def subclass_number(existing: Column, kind: Column, body: Column) -> Column:
    """Three digits from the subclass field, the visa type or the text, whichever has them first."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text(c), p, 1), F.lit("")) for c, p in ((existing, r"(\d{3})"), (kind, r"[sS]ubclass\s+(\d{3})"), (body, r"(?i)subclass\s+(\d{3})"))), F.lit(""))


def repaired_year(year: Column, cited: Column, url: Column | None = None) -> Column:
    """A year of 0 becomes the one in brackets of the citation; where there is no citation, the one that is a part of the URL's path."""
    cited = text(cited)
    sources = [F.when(cited != "", F.regexp_extract(cited, r"\[(\d{4})\]", 1))]
    if url is not None:
        sources.append(F.when(cited == "", F.regexp_extract(text(url), r"/(\d{4})/", 1)))
    found = F.coalesce(*sources, F.lit(""))
    return F.when((F.coalesce(year, F.lit(0)) == 0) & (found != ""), F.try_to_number(found, F.lit("9999")).cast("int")).otherwise(year)

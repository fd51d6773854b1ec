"""Categories read from the texts of a posting. Rules are tried in order; the first that applies decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobweft.functions.patterns import either, first_label, found

# Normalised employment types, with the patterns that name them, in the order they are tried.
EMPLOYMENT_RULES = [
    (r"\btemps plein\b", "Full-time"),
    (r"\btemps partiel\b", "Part-time"),
    (r"\bintern(ship)?\b|\bstagiaire\b|\bpracticante\b", "Internship"),
    (r"\bvolunteer\b|\bvoluntario\b", "Volunteer"),
    (r"\btemp(orary)?\b|\bseasonal\b|\bfixed[\s-]?term\b|\binterim\b|\bcasual\b|\bprn\b|\bper[\s-]?diem\b", "Temporary"),
    (r"\bcontract(or|ed)?\b|\bfreelance\b|\b1099\b|\bconsultant\b|\bb2b\b|\bcontrato\b", "Contract"),
    (r"\bpart[\s-]?time\b|\bparttime\b|\bmoonlight(er)?\b|\bmedio tiempo\b|\btiempo parcial\b|\bteilzeit\b", "Part-time"),
    (r"\bfull[\s-]?time\b|\bfulltime\b|\bpermanent\b|\bregular\b|\btiempo completo\b|\bvollzeit\b", "Full-time"),
]
EMPLOYMENT_NOTHING = ["other", "n/a", "unknown", "none", "n a"]
# Normalised workplace types.
WORKPLACE_RULES = [
    (r"\bhybrid\b", "Hybrid"),
    (r"\bremote\b|\bwork from home\b|\bwfh\b", "Remote"),
    (r"\bon ?site\b|\bin office\b|\bin person\b|\boffice\b", "Onsite"),
]
WORKPLACE_NOTHING = ["unspecified", "other", "n/a", "unknown"]
# What free text says of the workplace and the employment.
TEXT_REMOTE = r"\bremote\b|\bwork from home\b|\bwfh\b|\bfully remote\b|\b100% remote\b"
TEXT_HYBRID = r"\bhybrid\b|\bflex\s*office\b|\bpartially remote\b"
TEXT_ONSITE = r"\bon-site\b|\bonsite\b|\bin-office\b|\bin office\b|\bon site\b"
TEXT_EMPLOYMENT = [
    (r"\bfull[\s-]?time\b", "Full-time"), (r"\bpart[\s-]?time\b", "Part-time"), (r"\bcontract(?:or)?\b|\bfreelance\b|\b1099\b", "Contract"),
    (r"\binternship\b|\bintern\b", "Internship"), (r"\btemporary\b|\btemp\b", "Temporary"),
]
# Signs of remote work and against it.
REMOTE_YES = [r"\bfully\s*remote\b", r"\b100%\s*remote\b", r"\bwork\s*from\s*home\b", r"\bremote[\s-]*first\b", r"\bremote\s*position\b", r"\bremote\s*role\b",
              r"\bremote\s*job\b", r"\bremote\s*opportunity\b", r"\blocation:\s*remote\b", r"\bwork\s*remotely\b", r"\banywhere\b"]
REMOTE_NO = [r"\bnot\s*remote\b", r"\bnon[\s-]*remote\b", r"\bin[\s-]*office\b", r"\bon[\s-]*site\s*only\b", r"\bhybrid\b", r"\bremote\s*not\s*available\b", r"\bno\s*remote\b"]
REMOTE_EVERYWHERE = r"\b(?:worldwide|anywhere|global)\b"
# Places that tie a posting to a part of the world; the codes count in capitals only.
TIED = [
    r"\b(?:united\s*states|usa|u\.?s\.?)\b", r"\b(?:united\s*kingdom|uk)\b",
    r"\b(?:canada|germany|france|india|australia|china|japan|brazil|mexico|spain|italy|netherlands|ireland|singapore|israel|poland|portugal|switzerland|austria|sweden|norway|denmark|finland|belgium|czech|romania|hungary|philippines|indonesia|vietnam|thailand|malaysia|korea|taiwan|argentina|colombia|chile|peru|nigeria|kenya|south\s*africa|egypt|morocco|new\s*zealand)\b",
    r"\b(?:california|new\s*york|texas|florida|london|berlin|toronto|sydney|paris|amsterdam|dublin|munich|zurich|copenhagen|stockholm|oslo|barcelona|madrid|milan|rome|lisbon|warsaw|prague|budapest|bangalore|mumbai|delhi|shanghai|beijing|tokyo|seoul|manila|jakarta|bogota|sao\s*paulo|nairobi|cape\s*town|auckland)\b",
    r"\b(?:emea|apac|latam|latin\s*america|americas|north\s*america|south\s*america|asia|africa|middle\s*east|oceania)\b", r"\b(?:europe|european)\b",
]
TIED_CODES = r"\b(?:US|UK|CA|AU|DE|FR|IN|BR|JP|CN|SG|IE|NL|IL|PL|PT|CH|SE|NO|DK|FI|BE|CZ|RO|NZ)\b"
# Limits to a country in a description, work that is done on the spot, and cities in titles.
RESTRICTED = [r"\b(?:us|u\.?s\.?|united\s*states)\s*only\b", r"\b(?:uk|united\s*kingdom)\s*only\b", r"\bmust\s*be\s*(?:based|located)\s*in\b", r"\brestricted\s*to\b", r"\beligible\s*to\s*work\s*in\b",
              r"\bauthorized\s*to\s*work\s*in\b", r"\bresidents?\s*(?:of|only)\b", r"\bbased\s*(?:in|out\s*of)\s*(?:europe|the\s*us|the\s*uk|the\s*united)"]
ON_SPOT = r"\b(?:on[\-\s]?site|in[\-\s]?office|in[\-\s]?person)\s+(?:required|only|position|role)\b"
ON_SPOT_DAYS = r"\b(?:on[\-\s]?site|in[\-\s]?office|in[\-\s]?person)\s+(?:required|only|position|role|work|days?)\b"
ON_SPOT_TITLES = [
    r"\b(?:convention\s*center|warehouse|factory|store|restaurant|clinic|hospital)\b",
    r"\b(?:car\s*detail|janitor|custodian|forklift|housekeeper|cashier|bartender|barista|dishwasher|cook\b|chef\b|plumber|electrician|mechanic|driver|delivery|caregiver|nurse\b)",
    r"\b(?:dallas|fort\s*worth|new\s*york|chicago|los\s*angeles|san\s*francisco|houston|atlanta|miami|austin|denver|seattle|boston|portland|phoenix|charlotte|nashville|minneapolis|detroit|philadelphia|tampa|orlando|las\s*vegas|pittsburgh|indianapolis|columbus|raleigh|memphis|richmond|salt\s*lake|sacramento|san\s*diego|san\s*antonio|san\s*jose|terre\s*haute|south\s*oc)\b",
]
WORLD_LOCATION = r"\bworldwide\b|\bglobal\b|\bworld\b|\banywhere\b"
WORLD_TEXT = [r"\banywhere\s*in\s*the\s*world\b", r"\bwork\s*from\s*anywhere\b", r"\blocation\s*agnostic\b", r"\bglobally\s*distributed\b", r"\bfully\s*distributed\b", r"\bremote\s*worldwide\b", r"\bworldwide\s*remote\b",
              r"\bglobal\s*remote\b", r"\bremote\s*[\-–—]\s*global\b", r"\bno\s*location\s*requirement\b", r"\bopen\s*to\s*(?:all|any)\s*(?:location|countr)", r"\bremote\s*[\-–—]\s*anywhere\b"]
# Role labels by title, in the order they are tried; without boundaries, as part of a word too.
ROLE_RULES = [
    (r"software engineer|software developer", "Software Engineer"), (r"frontend|front-end|front end", "Frontend Developer"),
    (r"backend|back-end|back end", "Backend Developer"), (r"full stack|fullstack", "Fullstack Developer"), (r"data scientist", "Data Scientist"),
    (r"data analyst", "Data Analyst"), (r"data engineer", "Data Engineer"), (r"machine learning|ML engineer|AI engineer", "ML / AI Engineer"),
    (r"product manager", "Product Manager"), (r"project manager", "Project Manager"), (r"product designer|UX designer|UI designer", "Product Designer"),
    (r"devops|site reliability|SRE", "DevOps / SRE"), (r"QA|quality assurance|test engineer", "QA Engineer"), (r"mobile|iOS|android", "Mobile Developer"),
    (r"marketing", "Marketing"), (r"sales|account executive|business development", "Sales"), (r"customer success|customer support", "Customer Support"),
    (r"security|cybersecurity", "Security Engineer"), (r"cloud|infrastructure", "Cloud / Infrastructure"), (r"technical writer|content writer", "Technical Writer"),
    (r"recruiter|talent", "Recruiter"), (r"finance|accountant|financial", "Finance"), (r"human resources|HR ", "Human Resources"),
]
# Seniority in titles and texts.
LEVEL_INTERNSHIP = [r"\bintern(?:ship)?\b", r"\bco[\s-]?op\b", r"\bsummer\s*(?:student|analyst|associate)\b", r"\bstudent\b", r"\bapprentice", r"\btrainee\b"]
LEVEL_ENTRY = [r"\bentry[\s-]*level\b", r"\bjunior\b", r"\bjr\.?\b", r"\bnew\s*grad(?:uate)?\b", r"\brecent\s*grad(?:uate)?\b", r"\bfresh\s*grad(?:uate)?\b",
               r"\bgraduate\s*(?:program|role|position|engineer|analyst|developer)\b", r"\bassociate\s+\w+", r"\b(?:analyst|engineer|developer|designer)\s*[i1]\b",
               r"\b0[\s-]*(?:to|-)[\s-]*[12]\s*years?\b", r"\bno\s*experience\s*(?:required|needed|necessary)\b", r"\blevel\s*[i1]\b"]
LEVEL_MID = [r"\bmid[\s-]*(?:level|senior)\b", r"\b(?:analyst|engineer|developer|designer|associate)\s*(?:ii|2|iii|3)\b", r"\b[3-5]\+?\s*years?\b", r"\blevel\s*(?:ii|2|iii|3)\b"]
LEVEL_SENIOR = [r"\bsenior\b", r"\bsr\.?\b", r"\bstaff\b", r"\bprincipal\b", r"\b(?:analyst|engineer|developer|designer)\s*(?:iv|4|v|5)\b",
                r"\blead\s*(?:\w+\s+)?(?:engineer|developer|designer|analyst)\b", r"\b(?:7|8|9|10)\+?\s*years?\b", r"\blevel\s*(?:iv|4|v|5)\b"]
LEVEL_LEAD = [r"\bteam\s*lead\b", r"\btech\s*lead\b", r"\bengineering\s*(?:lead|manager)\b", r"\bmanager\b", r"\bhead\s*of\b", r"\bgroup\s*lead\b", r"\blead\b"]
LEVEL_EXECUTIVE = [r"\bdirector\b", r"\bvp\b", r"\bvice\s*president\b", r"\bc[etofi]o\b", r"\bchief\b", r"\bsvp\b", r"\bevp\b", r"\bpartner\b", r"\bfounding\b"]
OFFICE_ASSISTANT = r"\bexecutive\s+(?:assistant|administrator)\b|\b(?:administrative|admin)\s+assistant\b"
SALES_REP = r"\bsdr\b|\bbdr\b|\b(?:sales|business)\s+development\s+(?:representative|rep)\b"
SALES_EXECUTIVE = r"\b(?:account|sales|advertising|ad|media|client|commercial|relationship|key\s+account|enterprise|business\s+development|inside\s+sales|field\s+sales)\s+executive\b"
IC_MANAGER = r"\b(?:account|product|project|program|portfolio|category|brand|community|content)\s+manager\b|\bpartner(?:ships?)?\s+manager\b|\bproduct\s+owner\b"
BUSINESS_PARTNER = r"\b(?:business|people|hr|human\s+resources|talent|finance|tech(?:nology)?)\s+partner\b"
SENIOR_WORD = r"\b(?:senior|sr\.?|staff|principal|lead|enterprise|strategic)\b"
JUNIOR_WORD = r"\b(?:junior|jr\.?|entry[\s-]*level|associate|trainee|graduate|apprentice|assistant)\b"


def joined(*parts: Column) -> Column:
    return F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts])


def employment_type(raw: Column) -> Column:
    """Canonical employment type of a free-entered value, null if none is named."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.lower(raw), "&amp;", "&"), "[_/]+", " "))
    return F.when((text == "") | text.isin(EMPLOYMENT_NOTHING), None).otherwise(first_label(text, EMPLOYMENT_RULES, None))


def workplace_type(raw: Column) -> Column:
    """Canonical workplace type of a free-entered value, null if none is named."""
    text = F.trim(F.regexp_replace(F.lower(raw), r"[_\-\s]+", " "))
    return F.when((text == "") | text.isin(WORKPLACE_NOTHING), None).otherwise(first_label(text, WORKPLACE_RULES, None))


def workplace_in_text(title: Column, location: Column, description: Column) -> Column:
    """remote, hybrid or onsite as free text says; remote with hybrid beside it is hybrid."""
    text = joined(title, location, description)
    return F.when(found(text, TEXT_REMOTE), F.when(found(text, r"\bhybrid\b"), "hybrid").otherwise("remote")).when(found(text, TEXT_HYBRID), "hybrid").when(found(text, TEXT_ONSITE), "onsite")


def employment_in_text(title: Column, description: Column) -> Column:
    return first_label(joined(title, description), TEXT_EMPLOYMENT, None)


def is_remote(title: Column, location: Column, workplace: Column, description: Column) -> Column:
    """A structured type decides; then signs against, title, location, and signs in the text."""
    kind, text = F.lower(F.coalesce(workplace, F.lit(""))), joined(title, location, description)
    return (
        F.when(kind.isin("remote", "fully remote", "fully_remote"), True).when(kind.isin("hybrid", "on-site", "onsite", "in-office"), False)
        .when(found(text, either(*REMOTE_NO)), False).when(found(title, r"\bremote\b"), True)
        .when(found(location, r"\bremote\b") & ~found(location, "hybrid"), True).when(found(location, REMOTE_EVERYWHERE), True).otherwise(found(text, either(*REMOTE_YES)))
    )


def is_worldwide(title: Column, location: Column, description: Column, remote: Column) -> Column:
    """Whether a remote posting may be done anywhere: a place in title or location says no, a worldwide location yes, and without a location the description decides."""
    place = F.trim(F.coalesce(location, F.lit("")))
    tied = lambda c: found(c, either(*TIED)) | found(c, TIED_CODES, ignore_case=False)
    return (
        F.when(~F.coalesce(remote, F.lit(False)), False).when(tied(title), False).when((F.length(place) >= 2) & tied(place), False)
        .when(found(place, r"\banywhere\s+in\b") & ~found(place, r"\banywhere\s+in\s+the\s+world\b"), False)
        .when(found(description, ON_SPOT) | found(title, either(*ON_SPOT_TITLES)), False).when(found(place, WORLD_LOCATION), True)
        .when(F.length(place) < 3, ~found(description, either(*RESTRICTED, ON_SPOT_DAYS)) & found(description, either(*WORLD_TEXT))).otherwise(False)
    )


def role_category(title: Column) -> Column:
    return first_label(F.coalesce(title, F.lit("")), ROLE_RULES, "Other")


def _ranked(title: Column, base: str) -> Column:
    return F.when(found(title, SENIOR_WORD), "senior").when(found(title, JUNIOR_WORD), "entry").otherwise(base)


def experience_level(title: Column, description: Column) -> Column:
    """internship, entry, mid, senior, lead or executive, from the title first; null if nothing tells."""
    return (
        F.when(found(title, either(*LEVEL_INTERNSHIP)), "internship").when(found(title, OFFICE_ASSISTANT), "entry").when(found(title, SALES_REP), _ranked(title, "entry"))
        .when(found(title, either(SALES_EXECUTIVE, IC_MANAGER, BUSINESS_PARTNER)), _ranked(title, "mid"))
        .when(found(title, either(*LEVEL_ENTRY)), "entry").when(found(title, either(*LEVEL_EXECUTIVE)), "executive").when(found(title, either(*LEVEL_SENIOR)), "senior")
        .when(found(title, either(*LEVEL_LEAD)), "lead").when(found(title, either(*LEVEL_MID)), "mid")
        .when(found(description, either(*LEVEL_INTERNSHIP)), "internship").when(found(description, either(*LEVEL_ENTRY)), "entry")
    )

"""Values fixed by the data formats and rules this engine must agree with."""

# Query parameters that only track a click (compared without case; utm_* goes by prefix).
TRACKING_PARAMS = (
    "fbclid", "gclid", "dclid", "msclkid", "mc_cid", "mc_eid", "ocid", "cmpid", "taid", "smid", "sr_share",
    "__twitter_impression", "ref_src", "ref_url",
)

# Endings that only name a legal form.
LEGAL_FORMS = (
    "inc", "incorporated", "ltd", "limited", "llc", "plc", "corp", "corporation", "co", "sa", "ag", "gmbh",
    "lp", "llp", "ltee",
)

# Words that do not say which story a headline is about, English then French.
STOPWORDS_EN = """
the and for but not are was were been being has have had its his her hers him she they
them their our your you who whom what when where why how which that this these those than
then there here from into onto over under with without about after before amid among
against between during since until upon via per will would could should can may might
must shall does did doing done just also only more most much many some any all each every
other another such very new news says said say saying tells told report reports reported
update updates updated live watch video videos photos photo opinion analysis review first
last next year years week weeks day days today tonight yesterday tomorrow time times back
out off one two three four five get gets got make makes made take takes took know
"""
STOPWORDS_FR = """
les des une uns pour dans sur par avec sans sous vers chez entre selon après avant qui que
quoi dont est sont sera seront été être avoir fait faire font aux leur leurs ses son cette
ces cet comme mais plus moins pas très tout tous toute toutes nous vous ils elles lui elle
deux trois quatre cinq année années jour jours semaine aujourd hui hier demain nouveau
nouvelle nouvelles direct vidéo analyse chronique
"""

# FIPS 10-4 codes of the European Union's member states, and the group's code and name.
EU_CODE = "EU"
EU_NAME = "European Union"
EU_MEMBERS = (
    "AU", "BE", "BU", "HR", "CY", "EZ", "DA", "EN", "FI", "FR", "GM", "GR", "HU", "EI", "IT", "LG", "LH", "LU",
    "MT", "NL", "PL", "PO", "RO", "LO", "SI", "SP", "SW",
)
PINNED_PLACES = ("CA", "US", "EU")

# Three-letter source languages of translated lines, and language names in article lists.
LINE_LANGUAGES = {
    "fra": "fr", "spa": "es", "deu": "de", "por": "pt", "ita": "it", "zho": "zh", "ara": "ar", "rus": "ru",
    "jpn": "ja", "kor": "ko",
}
LIST_LANGUAGES = {
    "english": "en", "french": "fr", "spanish": "es", "german": "de", "portuguese": "pt", "italian": "it",
    "chinese": "zh", "arabic": "ar",
}

# Words naming an ownership form, in the order they are looked for.
OWNERSHIP_FORMS = (
    "crown corporation", "public company", "privately held", "company", "corporation", "cooperative",
    "co-operative", "nonprofit", "non-profit", "foundation", "trust", "department", "ministry", "agency",
    "government", "partnership",
)

# Page tags that carry a date, and page tags that carry section labels.
DATE_META = ("parsely-pub-date", "sailthru.date", "pubdate", "publishdate", "dc.date.issued", "dcterms.created")
LABEL_META = ("article:section", "article:tag", "news_keywords", "parsely-section", "parsely-tags")
LIST_META = ("news_keywords", "parsely-tags")

# Link types that announce a feed.
FEED_TYPES = (
    "application/rss+xml", "application/atom+xml", "application/rdf+xml", "application/xml", "text/xml",
)

# Host labels too general to identify an outlet.
GENERIC_LABELS = ("www", "ici", "m", "amp", "edition", "news", "en", "fr")

# Annual report forms; funding kinds in display order.
ANNUAL_FORMS = ("10-K", "20-F", "40-F")
FUNDING_KINDS = ("government_appropriation", "nonprofit_revenue", "grant", "public_filing", "charity_registration")

# Wording of date-check outcomes.
ZONE_CONFLICT = "time zones disagree in page metadata"
NO_DATE = "no date in page metadata"
DISALLOWED = "robots.txt disallows"

# Registry pages.
COMPANY_PAGE = "https://www.sec.gov/cgi-bin/browse-edgar?action=getcompany&CIK={}&type=&dateb=&owner=include&count=40"
COMPANY_DOCUMENT = "https://www.sec.gov/Archives/edgar/data/{}/{}/{}"
NONPROFIT_PAGE = "https://projects.propublica.org/nonprofits/organizations/{}"
CHARITY_PAGE = "https://apps.cra-arc.gc.ca/ebci/hacc/srch/pub/dsplyRprtngPrd?selectedCharityBn={}&dsrdPg=1"

# Knowledge-graph property and item identifiers.
P_INSTANCE, P_COUNTRY, P_WEBSITE, P_LOGO = "P31", "P17", "P856", "P154"
P_OWNED_BY, P_PARENT_ORG = "P127", "P749"
P_START, P_END, P_DIED, P_SHARE = "P580", "P582", "P570", "P1107"
P_CIK, P_EIN = "P5531", "P1297"
Q_HUMAN = "Q5"
NEWS_CLASSES = ("Q1193236", "Q11033")

"""Lexicons, rule constants and class names.

A lexicon entry is the body of a regular expression over lower-cased text. It
is matched between word boundaries; a trailing ``*`` leaves the end open, so
``sustainab*`` also finds "sustainability".
"""

# --- Fixed values: they decide scores, labels and masks, so they are stated as they are. ---

NOISE_TERMS = [
    "copyright infringement",
    "copyright act",
    r"17 u\.s\.c",
    "trademark infringement",
    "lanham act",
    "trade secret",
    "patent infringement",
    "defamation",
    "libel",
    "slander",
]

ESG_SIGNAL_TERMS = [
    "esg", "environmental", "greenwash*", "sustainab*",
    "climate", "greenhouse", "scope [123]", "carbon",
    "pollution", "clean air act", "clean water act",
    "cercla", "epa", "governance", "fiduciary",
    "erisa", "proxy voting", "board composition",
    "executive compensation", "shareholder rights",
    "securities fraud", "disclosure", "dei",
    "diversity", "human rights", "supply chain",
    "forced labor", "labor rights", "human capital",
    "worker safety", "osha", "net zero",
]

PILLAR_E_TERMS = [
    "climate", "greenhouse", "scope [123]", "carbon",
    "pollution", "clean air act", "clean water act",
    "cercla", "epa", "greenwash*", "net zero",
    "biodiversity", "emissions", "csrd", "sb 253",
]

PILLAR_S_TERMS = [
    "human rights", "supply chain", "forced labor",
    "uflpa", "dei", "diversity", "worker safety",
    "osha", "labor rights", "human capital",
    "title vii", "flsa", "nlra", "csddd",
    "consumer protection", "political spending",
]

PILLAR_G_TERMS = [
    "fiduciary", "erisa", "proxy voting",
    "board composition", "executive compensation",
    "shareholder rights", "securities fraud",
    "disclosure", "fcpa", "sarbanes", "dodd.frank",
    "corporate governance", "dol", "29 cfr",
]

SUSTAINABILITY_TERMS = [
    "sustainab*", "brundtland", "long.term viability",
    "net zero", "circular economy", "sdg",
    "responsible investment", "pri",
]

NOISE_DOMAIN_TERMS = [
    "copyright", "trademark", "patent",
    "antitrust", "sherman act",
]

# Court name -> phrases, any case; the first court with a phrase in the text wins.
COURTS = {
    "SDNY": ["S.D. New York", "Southern District of New York"],
    "CD Cal": ["C.D. California", "Central District of California"],
    "ND Cal": ["N.D. California", "Northern District of California"],
    "ND Tex": ["N.D. Texas"],
    "SD Tex": ["S.D. Texas"],
    "9th Cir": ["Ninth Circuit"],
    "2nd Cir": ["Second Circuit"],
    "5th Cir": ["Fifth Circuit"],
    "DC Cir": ["District of Columbia Circuit", "D.C. Circuit"],
    "Del Ch": ["Delaware Court of Chancery", "Del. Ch."],
    "SCOTUS": ["Supreme Court of the United States"],
}

OUTCOME_TERMS = [
    "dismissed", "granted", "affirmed", "reversed",
    "remanded", "vacated", "denied", "overruled",
    "enjoined", "prevailed", "affirming", "reversing",
    "remanding", "vacating",
]

OUTCOME_TRIGGERS = [
    "motion", "judgment", "appeal", "order", "verdict", "court", "hereby",
    "is", "are", "be", "was", "were", "has been", "have been",
]

OUTCOME_MASK = "[OUTCOME]"

# The general English stop words (318) that the term tables leave out.
GENERAL_STOP_WORDS = [
    "a", "about", "above", "across", "after", "afterwards", "again", "against", "all", "almost",
    "alone", "along", "already", "also", "although", "always", "am", "among", "amongst",
    "amoungst", "amount", "an", "and", "another", "any", "anyhow", "anyone", "anything", "anyway",
    "anywhere", "are", "around", "as", "at", "back", "be", "became", "because", "become",
    "becomes", "becoming", "been", "before", "beforehand", "behind", "being", "below", "beside",
    "besides", "between", "beyond", "bill", "both", "bottom", "but", "by", "call", "can",
    "cannot", "cant", "co", "con", "could", "couldnt", "cry", "de", "describe", "detail", "do",
    "done", "down", "due", "during", "each", "eg", "eight", "either", "eleven", "else",
    "elsewhere", "empty", "enough", "etc", "even", "ever", "every", "everyone", "everything",
    "everywhere", "except", "few", "fifteen", "fifty", "fill", "find", "fire", "first", "five",
    "for", "former", "formerly", "forty", "found", "four", "from", "front", "full", "further",
    "get", "give", "go", "had", "has", "hasnt", "have", "he", "hence", "her", "here", "hereafter",
    "hereby", "herein", "hereupon", "hers", "herself", "him", "himself", "his", "how", "however",
    "hundred", "i", "ie", "if", "in", "inc", "indeed", "interest", "into", "is", "it", "its",
    "itself", "keep", "last", "latter", "latterly", "least", "less", "ltd", "made", "many", "may",
    "me", "meanwhile", "might", "mill", "mine", "more", "moreover", "most", "mostly", "move",
    "much", "must", "my", "myself", "name", "namely", "neither", "never", "nevertheless", "next",
    "nine", "no", "nobody", "none", "noone", "nor", "not", "nothing", "now", "nowhere", "of",
    "off", "often", "on", "once", "one", "only", "onto", "or", "other", "others", "otherwise",
    "our", "ours", "ourselves", "out", "over", "own", "part", "per", "perhaps", "please", "put",
    "rather", "re", "same", "see", "seem", "seemed", "seeming", "seems", "serious", "several",
    "she", "should", "show", "side", "since", "sincere", "six", "sixty", "so", "some", "somehow",
    "someone", "something", "sometime", "sometimes", "somewhere", "still", "such", "system",
    "take", "ten", "than", "that", "the", "their", "them", "themselves", "then", "thence",
    "there", "thereafter", "thereby", "therefore", "therein", "thereupon", "these", "they",
    "thick", "thin", "third", "this", "those", "though", "three", "through", "throughout", "thru",
    "thus", "to", "together", "too", "top", "toward", "towards", "twelve", "twenty", "two", "un",
    "under", "until", "up", "upon", "us", "very", "via", "was", "we", "well", "were", "what",
    "whatever", "when", "whence", "whenever", "where", "whereafter", "whereas", "whereby",
    "wherein", "whereupon", "wherever", "whether", "which", "while", "whither", "who", "whoever",
    "whole", "whom", "whose", "why", "will", "with", "within", "without", "would", "yet", "you",
    "your", "yours", "yourself", "yourselves",
]

LEGAL_STOP_WORDS = [
    "outcome",
    "court", "courts", "plaintiff", "plaintiffs", "defendant", "defendants",
    "case", "cases", "claim", "claims", "action", "actions",
    "pursuant", "herein", "hereof", "thereof", "therein", "whereby",
    "said", "shall", "may", "also", "well", "one", "two", "three",
    "mr", "ms", "dr", "inc", "llc", "corp", "ltd", "co",
    "however", "therefore", "thus", "further", "although",
    "january", "february", "march", "april", "june", "july",
    "august", "september", "october", "november", "december",
    "filed", "finding", "found", "held", "holding", "order",
    "judge", "judges", "justice", "opinion", "slip",
    "number", "nos", "no", "app", "supp", "cir", "dist",
    "id", "ibid", "supra", "infra", "et", "al", "see", "cf",
]

LABELS = ["E", "S", "G", "Non-ESG"]
LABEL_NAMES = {"E": "Environmental", "S": "Social", "G": "Governance", "Non-ESG": "Non-ESG"}

NOISE_OVERRIDE = 3        # signals that keep a document in spite of noise
TOKEN_LIMIT = 512         # tokens above which a document is flagged
YEAR_WINDOW = 2000        # characters searched for a year
SKEW_SHARE_PCT = 15.0     # a class below this share is flagged
RARE_CASES = 10           # a flag with fewer documents is flagged
OVERLONG_PCT = 20.0       # share of long documents above which they need another model
LOW_SIGNAL_ROWS = 20      # a class with fewer training rows is flagged
SEED = 42
FOLD_SEEDS = [42, 123, 7]
FOLDS = 3
TEST_SHARE = 0.15
VAL_SHARE = 0.15
MIN_DF = 3
MAX_FEATURES = 20_000
NGRAM_MIN_DF = 2

# --- End of fixed values. ---

STOP_WORDS = sorted({*GENERAL_STOP_WORDS, *LEGAL_STOP_WORDS})
CLASSES = sorted(LABELS)  # index order of encoded labels

"""Values that must be equal for results to agree: patterns, word lists, limits, formats.

Everything here is a constant. Patterns are written in the Java dialect Spark uses; `(?U)` gives
Unicode classes where the text rules need them.
"""

# ---- fixed values: patterns -------------------------------------------------------------------
SPACES = "".join(map(chr, (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
# anything but Latin-1 that cleaning leaves alone; single characters, so the engine looks each up in one table
NOISY = "[^" + "".join(map(chr, (*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xA1, 0x100)))) + "".join(
    "\\" + c for c in " !\"$%&'()+,-./:;<=?@[\\]^_{|}~") + "]"
DATE = r"20\d\d-\d\d-\d\d"
SEPARATOR = r"[-_ ]+"
WORD = r"[A-Za-z0-9][A-Za-z0-9'-]*"
EVAL_TERM = r"[a-z0-9][a-z0-9_.-]*[a-z0-9]"
WORD4 = r"[a-z0-9]{4,}"
NUMBER = r"\d[\d.,:/-]*\d|\d"
SECRET = r"[A-Za-z0-9_/+=-]{32,}"
TOKEN_CLASS = r"A-Za-z0-9_/+=.\-"
KNOWN_KEY = r"\b(?:sk-|ghp_|gho_|github_pat_|xox[abpr]-|AKIA|AIza|eyJ)[A-Za-z0-9_.-]{16,}"
UUID = r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}"
URL = r"https?://[^\s)\"'<>\]]+"
WIKILINK = r"\[\[([^\]|#]+)"
CITATION = r"\s+et al\b|,?\s[A-Z]{1,2}[.,]|,\s[A-Z]\."
PRIVATE = r"(?s)<private>.*?</private>"
NOISE = r"(?s)<(system-reminder|local-command-\w+|command-\w+|task-notification)>.*?</\1>"
NO_INDEX = "DO NOT INDEX THIS CHAT"
META = r"\s\[([a-z_]+:\s*[^;\]]+(?:;\s*[a-z_]+:\s*[^;\]]+)*)\](?:\s*·.*)?$"
SINCE = r"\(since (20\d\d-\d\d-\d\d); (k:[0-9a-f]{10}(?:, k:[0-9a-f]{10})*)\)"
BULLET_HEAD = r"^\s*[-*] (?:\[[ x]\] )?(?:[A-Za-z][A-Za-z /]{0,30}: ?)?"
BULLET = r"^\s*[-*] (?:\[[ x]\] )?(?:([A-Za-z][A-Za-z /]{0,30}): ?)?(.*)$"
FACT = r"^- (Overview|Decision|State|Open|Fact): (.+) \(since (\d{4}-\d{2}-\d{2}); (k:[0-9a-f]{10}(?:, k:[0-9a-f]{10})*)\)$"
ENTRY_KEY = r"<!--k:([0-9a-f]{10})-->"
ENTRY_LINE = r"^- (20\d\d-\d\d-\d\d)(?: (\d{1,2}:\d\d))? · (?:\[\[([^|\]]+)\|[^\]]*\]\]|`([^`]+)`) · (.*?) ?<!--k:([0-9a-f]{10})-->"
NOT_FOUND = (r"(?i)\b(not found|no record|never mentioned|not mentioned|no mention|"
             r"does not appear|doesn't appear|nothing (?:in|on) )")
UNKNOWN = r"(?i)^\W*(unknown|not (found|mentioned|stated)|no (information|record))\b"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"

# ---- fixed values: markers and names ------------------------------------------------------------
START, END = "<!-- index:start -->", "<!-- index:end -->"
KINDS = ["person", "project", "harness", "area", "topic"]
FACT_KINDS = ["Overview", "Decision", "State", "Open", "Fact"]
HOUSEKEEPING = ["Defining notes", "Links", "Summary as of", "Tags"]
SUPERSEDED, ARCHIVED = "### Superseded", "### Archived as written"
MARKER = "<!-- consolidated -->"
MARKER_PATTERN = r"<!-- consolidated[^\n]*-->"
ECHO = "(synced via audit-to-vault)"
DIGEST_PRIORITY = ["prompt", "reply", "step", "file", "url", "cmd"]
FILE_TOOLS = ["Read", "Edit", "Write", "MultiEdit", "NotebookEdit"]
EVAL_FIELDS = ["id", "category", "question", "answer", "keys", "gold", "as_of", "split", "note"]
EVAL_CATEGORIES = ["single", "temporal", "multihop", "abstention", "transcript"]
EVAL_SPLITS = ["frozen", "heldout"]
LINT_PASSES = ["unsourced", "exact_dup", "near_dup", "contradiction", "stale", "broken_link"]
GENERIC = ["the", "a", "an", "session", "meetup", "night", "track", "party", "cafe", "local", "at", "of"]

# ---- fixed values: limits -----------------------------------------------------------------------
CAP, DIGEST_BUDGET = 2000, 16000
NEAR, CONTRA = 0.8, 0.5
K1, B = 1.2, 0.75
RRF_K = 60
DENSE_DEPTH, FUSE_DEPTH, HOP_CARDS = 200, 300, 3
HOP_SHARE, SECTION_SHARE = 0.4, 0.35

# ---- fixed values: stop words -------------------------------------------------------------------
STOP_EVAL = """a about after again all also an and any are as at be been before being both but by can
could did do does doing done for from had has have having he her here him his how i if in into is it
its just me more most my no nor not now of off on once only or other our out over own same she should
so some such than that the their them then there these they this those through to too under until up
us very was we were what when where which while who whom why will with would you your""".split()
STOP_DOMAIN = STOP_EVAL + "current currently date daily notes note person people project".split()
STOP_FACTS = """this that with from have been were will what when which their there about into than then
they them also only more most some such each other over after before same very just""".split()

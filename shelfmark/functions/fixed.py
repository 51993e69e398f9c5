"""Fixed values. Results depend on each of them; they are all defaults of arguments."""

# Keywords that declare what a package is.
TYPE_MARKERS = ("pi-extension", "pi-skill", "pi-theme", "pi-prompt")
TYPE_PREFIX = "pi-"
CATALOGUE_KEYWORD = "pi-package"

# Accounts that publish for someone else.
CI_ACCOUNTS = ("GitHub Actions", "github-actions[bot]", "semantic-release-bot", "npm-publish")

# Signs that a package serves several assistants.
MULTI_KEYWORDS = (
    "claude-code", "codex", "opencode", "gemini-cli", "windsurf", "copilot", "cline", "kiro", "qoder",
)
MULTI_PHRASES = (
    "claude code", "gemini cli", "windsurf", "opencode", " codex ", "copilot cli", "cursor ide",
)

# Words common to nearly every package: not used for similarity.
DOMAIN_STOP_WORDS = (
    "pi", "extension", "skill", "theme", "prompt", "package", "plugin", "tool", "tools",
    "agent", "coding", "install", "support", "use", "using", "provide", "allow", "enable",
    "work", "help", "simple", "easy", "based", "powered", "like", "add", "get", "set",
    "new", "make", "build", "run", "just", "also", "via", "per", "let", "need", "want",
    "search", "fetch", "query", "request", "response", "api", "url", "http", "https",
)

# Further words not used to describe clusters.
CLUSTER_STOP_WORDS = DOMAIN_STOP_WORDS + (
    "feature", "features", "available", "current", "version", "latest", "update",
    "project", "code", "file", "files", "text", "output", "input", "user", "users",
)

# Words never used in a cluster name.
NAMING_STOP_WORDS = (
    "extension", "package", "coding", "support", "agent", "based", "using", "provides",
    "allows", "simple", "easily", "within", "directly", "without", "through", "custom",
    "users", "default", "manage", "access", "create", "content", "system", "across",
    "messages", "integrate", "integration", "install", "installed", "adding", "added",
    "lightweight", "configurable", "designed", "built", "available", "interface",
    "readme", "release", "badge", "english", "align", "center", "latest", "build",
    "github", "httpspidev", "pihttps", "httpspi", "pidev", "pipackage",
    "following", "below", "above", "usage", "example", "examples", "documentation",
    "right", "left", "first", "second", "third", "every", "when", "with",
)

# Words left out of the word-frequency dataset.
FREQUENCY_STOP_WORDS = (
    "this", "that", "with", "from", "have", "will", "your", "their", "they", "been", "also",
    "which", "more", "some", "into", "such", "than", "just", "each", "about", "over", "then",
    "when", "where", "there", "these", "those", "what", "would", "could", "should", "other",
    "after", "while", "being", "using", "used", "uses", "adds", "make", "makes", "made",
    "gets", "lets", "runs", "take", "takes", "give", "gives", "help", "helps", "allow",
    "allows", "build", "built", "based", "simple", "simply", "easy", "small", "tool",
    "tools", "work", "works", "support", "provide", "provides", "include", "includes",
    "feature", "features", "package", "packages", "extension", "extensions", "coding",
    "agent", "install", "http", "https", "npm", "readme",
)

# Phrases that say a work derives from another one.
DERIVATION_PHRASES = (
    "fork", "forked from", "based on", "inspired by", "alternative to", "port of",
    "similar to", "derived from", "originally from", "credits? to", "see also",
)

# Similarity graph.
SPECIFIC_WEIGHT = 0.55
PROSE_WEIGHT = 0.45
NEIGHBOURS = 20
NEIGHBOUR_THRESHOLD = 0.15
HOP_DECAY = 0.7
NEAR_DUPLICATE_THRESHOLD = 0.25

# Clusters.
COHESION_MIN = 0.52
COHESION_SAMPLE = 80
TEXT_CLUSTERS = 12
VECTOR_CLUSTERS = 24
TEXT_RESTARTS = 10
VECTOR_RESTARTS = 20
VECTOR_ITERATIONS = 500
REDUCED_DIMENSIONS = 50

# Markdown punctuation, and what plain prose leaves out: tags, URLs, links, emphasis marks.
MARKDOWN = r"[#*`\[\](){}|>]"
NOT_PROSE = r"<[^>]+>|https?://\S+|\[.*?\]\(.*?\)|#+|[|`*_]"

# Spark ML's English stop words (StopWordsRemover.loadDefaultStopWords("english")).
ENGLISH_STOP_WORDS = tuple(
    """
    a about above after again against all am an and any are aren't as at be because been before being below
    between both but by can can't cannot could couldn't did didn't do does doesn't doing don don't down
    during each few for from further had hadn't has hasn't have haven't having he he'd he'll he's her here
    here's hers herself him himself his how how's i i'd i'll i'm i've if in into is isn't it it's its itself
    just let's me more most mustn't my myself no nor not now of off on once only or other ought our ours
    ourselves out over own s same shan't she she'd she'll she's should shouldn't so some such t than that
    that's the their theirs them themselves then there there's these they they'd they'll they're they've
    this those through to too under until up very was wasn't we we'd we'll we're we've were weren't what
    what's when when's where where's which while who who's whom why why's will with won't would wouldn't you
    you'd you'll you're you've your yours yourself yourselves
    """.split()
)

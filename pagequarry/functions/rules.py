"""Fixed values that define the semantics: selectors, words and patterns, in priority order."""

# Generic content strategy.
CONTENT_SELECTORS = (
    "article.documentation", "main.content", "article", "main", "div[role='main']", "div.content", "div.documentation",
    "div.main-content", "div.doc-content", ".markdown-body", "#content", "#main-content", ".content-container",
)
NOISE_SELECTORS = (
    "header", "footer", "nav", ".sidebar", ".navigation", ".menu", ".toc", ".breadcrumbs", ".admonition", ".search",
    ".cookie-banner", "script", "style", "iframe", "noscript", "[aria-hidden='true']", ".ads", ".announcement", ".modal", ".popup",
)
UNSCORED_CLASSES = ("nav", "menu", "header", "footer", "sidebar")

# Generic link strategy.
NAV_SELECTORS = (
    "nav", ".sidebar", ".navigation", ".toc", "aside", "#sidebar", "#menu", "#toc", ".doc-menu", ".doc-nav", ".menu",
    "header nav", "footer nav", "[role='navigation']",
)
CONTENT_LINK_SELECTORS = ("article a", "main a", ".content a", ".documentation a", ".main-content a")
NEXT_WORDS = ("next", "next page", "continue", "→", ">>", "próximo", "siguiente", "weiter")
PREVIOUS_WORDS = ("previous", "prev", "back", "←", "<<", "anterior", "vorherige")
ASSET_EXTENSIONS = r"\.(zip|pdf|png|jpg|jpeg|gif|svg|webp|mp4|webm|mp3|ogg|wav|css|js)$"
UNFOLLOWED_TEXTS = ("login", "sign in", "register", "download", "buy", "forum", "blog", "contact", "privacy", "terms", "careers")
VERSION_QUERY = r"(version|v|doc_version|release)="
DOC_PATHS = ("/docs?/", "/documentation/", "/guide/", "/tutorial/", "/reference/", "/manual/", "/learn/", "/api/", "/wiki/")

# Link relevance, on paths.
RELEVANT_PATHS = (
    r"/(docs|documentation|manual|guide|tutorial|reference|api|learn|help|faq)/.*",
    r".*\.(md|markdown|html|htm|rst|txt|pdf)$",
    r"/v\d+/.*",
    r"/.*#.*",
    r"/(get[-_]?started|quick[-_]?start|introduction|overview|examples|concepts|how[-_]?to)(/|$)",
)
IRRELEVANT_PATHS = (
    r".*\.(jpg|jpeg|png|gif|svg|webp|mp4|webm|mp3|wav|zip|tar\.gz|exe|dmg)$",
    r"/(login|signin|signup|register|account|profile|contact|about|pricing|blog|news|forum|community|download)(/|$)",
    r"/(twitter|facebook|linkedin|instagram|github|youtube)(/|$)",
    r".*\?(utm_|fbclid|gclid).*",
)
RELEVANCE_THRESHOLD = 0.7

# Wiki content strategy.
WIKI_TITLE_SELECTORS = (
    "h1.deepwiki-title", "h1.wiki-title", "h1.article-title", "div.deepwiki-header h1", "div.page-header h1",
    "h1.document-title", "h1:first-of-type", "h1", "h2.deepwiki-title", "h2:first-of-type", "title",
)
WIKI_CONTENT_SELECTORS = (
    "div.documentation-content", "div.wiki-content", "div.deepwiki-content", "div.deepwiki-article", "main.content-wrapper",
    "div.content-wrapper", "div.deepwiki-container main", "div.deepwiki-container div.main", "div.deepwiki-body", "article.content",
    "article.wiki-article", "div.article-content", "div.doc-content", "main", "article", "div[role='main']", "div.main",
)
WIKI_EXCLUDED = (
    "div.deepwiki-sidebar", "div.sidebar", "nav", "header", "footer", "div.deepwiki-nav", "div.navigation",
    "div.table-of-contents", "div.toc", "div.deepwiki-header", "div.deepwiki-footer", "div.api-info", "div.version-info",
    "div.edit-options", "div.comments", "div.deepwiki-comments",
)
WIKI_EDIT_LINKS = ("a.deepwiki-edit", "a.wiki-edit", "a.edit-page", "a.edit-link")
WIKI_DROPPED_CLASSES = ("deepwiki-pages", "deepwiki-nav", "page-operations", "toc-wrapper")
WIKI_CODE_CLASSES = ("code-block", "highlight", "deepwiki-code", "source-code")
ADMONITIONS = ("note", "warning", "info", "alert", "admonition")
API_HEADINGS = r"(?i)API Reference|API Documentation|Method Reference|Function Reference|Class Reference"

# Wiki link strategy.
WIKI_NAV_SELECTORS = (
    "nav.deepwiki-nav", "div.deepwiki-navigation", "div.deepwiki-sidebar", "div.wiki-sidebar", "div.documentation-sidebar",
    "aside.sidebar", "nav.sidebar", "div.toc-sidebar", "div.left-sidebar", "div.right-sidebar", "div.sidebar-wrapper",
    "div.table-of-contents", "div.toc", "nav.toc", "div.deepwiki-toc", "ul.deepwiki-menu", "ul.wiki-menu", "ul.doc-menu",
    "div.menu-container", "nav", "div[role='navigation']", "ul.navigation",
)
WIKI_AREA_SELECTORS = (
    "div.documentation-content", "div.wiki-content", "div.deepwiki-content", "div.deepwiki-article", "main.content-wrapper",
    "article", "main", "div.content",
)
WIKI_RELATED_SELECTORS = (
    "div.see-also", "div.related-pages", "div.related-topics", "div.deepwiki-related", "section.related-links",
    "div.next-prev-links", "div.page-navigation", "div.article-footer",
)
WIKI_EXCLUDED_LINKS = (
    "/edit/", "/raw/", "/history/", "/blame/", "/commits/", "/issues/", "/pull/", "/compare/", "/settings/", "/export/",
    r"/search\?", "/login", "/logout", "/register",
)
WIKI_DOC_LINKS = (r"/docs/", r"/documentation/", r"/guide/", r"/tutorial/", r"/manual/", r"/reference/", r"/wiki/", r"\.md$", r"\.html$")
WIKI_DOC_TEXTS = (r"doc(s|umentation)?", "guide", "tutorial", "manual", "reference", "api", r"how\s+to", "learn", "example")
ACTIVE_CLASSES = ("active", "current", "selected", "deepwiki-active")
ENTRY_WORDS = ("index", "overview", "introduction", "getting started")
OLD_WORDS = ("deprecated", "legacy", "archive")

# Requests.
MODES = ("generic", "auto", "wiki")
CONTENT_TYPES = ("documentation", "code", "api", "tutorial", "reference", "general")
PROCESSING_MODES = ("clean", "summarize", "restructure", "extract_code", "format")
FILTER_KINDS = ("include", "exclude", "priority")
EXPORT_FORMATS = ("json", "markdown", "both")
STATUSES = ("pending", "running", "completed", "failed", "canceled")

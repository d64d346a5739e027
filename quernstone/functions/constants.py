"""Fixed values that results depend on."""

from __future__ import annotations

#: Sizes and limits.
CHUNK_SIZE, CHUNK_OVERLAP = 800, 150
VECTOR_SIZE = 384
MAX_UPLOAD = 50 * 1024 * 1024
SCAN_WINDOW = 65_536
READABLE_RATIO = 0.92
DEFAULT_USER = "local-dev"
HYBRID_COSINE, HYBRID_KEYWORD, HYBRID_POOL, HYBRID_TAGS = 0.72, 0.28, 3, 4
EXCERPT_LENGTH, EXCERPT_SNAP = 220, 80
HISTORY_WINDOW, STREAM_SLICE = 6, 80
MIN_CONFIDENCE, RELEVANCE_CUT = 0.7, 0.55
OTHER_SOURCE_BOOST = 0.05
PATTERN_CONFIDENCE, COOCCURRENCE_CONFIDENCE = 0.78, 0.52

#: Accepted file extensions, and patterns that make an upload unsafe (fewer for HTML).
EXTENSIONS = ("md", "txt", "pdf", "docx", "py", "js", "ts", "json", "csv", "html", "htm")
TEXT_EXTENSIONS = ("md", "txt", "py", "js", "ts", "json", "csv", "html", "htm")
DANGER = (r"<script[\s>]", r"javascript\s*:", r"vbscript\s*:", r"on\w{2,20}\s*=\s*[\"']", r"data\s*:\s*text/html")
DANGER_HTML = (r"javascript\s*:", r"vbscript\s*:", r"data\s*:\s*text/html")

#: Spellings of search terms.
TOKEN_ALIASES = {"js": "javascript", "nodejs": "node.js", "ml": "machine-learning"}

#: Known terms by label; each with further spellings.
GAZETTEER = {
    "PROGRAMMING_LANGUAGE": {
        "Python": (),
        "JavaScript": ("js",),
        "TypeScript": ("ts",),
        "Java": (),
        "Go": ("golang",),
        "Rust": (),
    },
    "FRAMEWORK": {
        "React": ("reactjs",),
        "Vue": ("vue.js", "vuejs"),
        "Angular": (),
        "FastAPI": (),
        "Django": (),
        "Flask": (),
        "Node.js": ("nodejs",),
        "TensorFlow": (),
        "PyTorch": (),
        "Keras": (),
        "Celery": (),
    },
    "LIBRARY": {
        "NumPy": (),
        "pandas": (),
        "spaCy": (),
        "Lodash": (),
        "JSON5": (),
    },
    "DATABASE": {
        "ChromaDB": ("chroma",),
        "Neo4j": (),
        "PostgreSQL": ("postgres",),
        "Redis": (),
    },
    "TOOL": {
        "Docker": ("docker compose",),
    },
    "CONCEPT": {
        "API": ("apis",),
        "REST": ("rest api", "restful"),
        "HTTP": ("https",),
        "JSON": (),
        "Markdown": (),
        "GraphQL": (),
        "Database": ("databases",),
        "Graph Database": (),
        "Vector Database": ("vector db", "向量数据库"),
        "Knowledge Graph": ("知识图谱",),
        "Knowledge Base": ("知识库",),
        "Semantic Search": ("语义搜索",),
        "Hybrid Search": ("混合搜索",),
        "Retrieval Augmented Generation": ("rag", "检索增强生成"),
        "Large Language Model": ("llm", "llms", "大语言模型"),
        "Entity Extraction": ("实体识别",),
        "Named Entity Recognition": ("ner", "命名实体识别"),
        "Chunking": ("chunk", "chunks"),
        "Embedding": ("embeddings",),
        "Vector Embedding": ("vector embeddings", "向量嵌入"),
        "Reranking": ("rerank", "reranker"),
        "Document Ingestion": (),
        "Text Extraction": (),
        "Document Parsing": ("文档解析",),
        "Document Upload": ("文档上传",),
        "Machine Learning": ("ml", "机器学习"),
        "Deep Learning": ("深度学习",),
        "Neural Network": ("neural networks",),
        "Artificial Intelligence": ("ai", "人工智能"),
        "Natural Language Processing": ("nlp", "自然语言处理"),
        "Computer Vision": (),
    },
}
ALIASES = {a.lower(): (name, label) for label, names in GAZETTEER.items() for name, more in names.items() for a in (name, *more)}
#: Lower-case terms that count as known though no text is scanned for them.
KNOWN_ONLY = ("c++", "c#", "array", "sampling", "data structure")

#: Labels in order of preference, labels that are relevant by themselves.
LABEL_PRIORITY = {
    "PROGRAMMING_LANGUAGE": 100, "FRAMEWORK": 95, "LIBRARY": 90, "DATABASE": 88, "TOOL": 86, "CONCEPT": 85, "ORGANIZATION": 80, "PERSON": 80,
    "LOCATION": 75, "PRODUCT": 75, "CLASS": 70, "FUNCTION": 68, "DATE": 50, "VERSION": 30, "RESOURCE": 20,
}
RELEVANT_LABELS = ("PROGRAMMING_LANGUAGE", "FRAMEWORK", "LIBRARY", "DATABASE", "TOOL", "CONCEPT", "FUNCTION", "CLASS", "DOCUMENT", "REPOSITORY")
#: Words that make no entity; words that make none alone; words near a real place.
STOP_CONCEPTS = ("the", "and", "for", "with", "from", "this", "that", "module", "file", "function", "class", "return", "array", "sample", "size", "value", "values", "item", "items", "data", "object", "option", "options", "result", "config", "path", "name", "type")
GENERIC_WORDS = ("generate", "jargon", "method", "principle", "principles", "overview", "summary", "introduction", "example", "examples", "note", "notes", "content", "section", "chapter")
GEOGRAPHY = ("address", "area", "country", "county", "geography", "map", "province", "region", "state", "street")
#: Shapes of entity texts that are noise (lower case).
NOISE = (
    r"^[0-9a-f]{6,}(?:[_-][0-9]+)?$", r"^[a-z0-9]{6,}[_-][0-9]+$", r"^[0-9]+\.[0-9]+\.[0-9]+(?:\s+\S+)?", r"^[0-9]{1,2}:[0-9]{2}\s*(?:am|pm)?$",
    r"^(monday|tuesday|wednesday|thursday|friday|saturday|sunday)([^\pL\pN_]|$)", r"^[0-9]+[+\-]$", r"^(the|a|an)\s+\S+", r"^.{1,2}$",
)
#: Relation between two entities of one sentence, by their labels; any other pair is RELATED_TO.
TYPE_PAIRS = {
    ("PROGRAMMING_LANGUAGE", "FRAMEWORK"): "HAS_FRAMEWORK", ("FRAMEWORK", "PROGRAMMING_LANGUAGE"): "WRITTEN_IN", ("PROGRAMMING_LANGUAGE", "LIBRARY"): "HAS_LIBRARY",
    ("LIBRARY", "PROGRAMMING_LANGUAGE"): "WRITTEN_IN", ("FRAMEWORK", "LIBRARY"): "USES", ("LIBRARY", "FRAMEWORK"): "USED_BY", ("FRAMEWORK", "DATABASE"): "USES", ("DATABASE", "FRAMEWORK"): "USED_BY",
    ("TOOL", "FRAMEWORK"): "INTEGRATES_WITH", ("TOOL", "LIBRARY"): "INTEGRATES_WITH", ("PERSON", "ORGANIZATION"): "ASSOCIATED_WITH", ("ORGANIZATION", "PERSON"): "ASSOCIATED_WITH",
}
PATTERN_RELATIONS = {"IS_A": r"is\s+a", "USES": r"uses", "DEVELOPED_BY": r"developed\s+by", "BUILT_WITH": r"built\s+with", "BASED_ON": r"based\s+on"}
#: Node and edge types that a drawn graph hides.
HIDDEN_NODES = ("VERSION", "RESOURCE", "REPOSITORY", "CSV_VALUE", "LOCATION", "DATE", "TIME")
HIDDEN_EDGES = ("MENTIONS_WITH",)
#: Names that count as frameworks in answers; words that name no document; words that are no concept.
FRAMEWORK_NAMES = ("Angular", "ChromaDB", "Django", "Docker", "FastAPI", "Flask", "Keras", "Lodash", "Neo4j", "Node.js", "NumPy", "pandas", "PostgreSQL", "PyTorch", "React", "Redis", "TensorFlow", "Vue")
TITLE_STOP = ("about", "content", "design", "document", "file", "main", "summary", "summarize", "tell", "the", "what", "what's")
CONCEPT_STOP = ("about", "after", "assignment", "before", "class", "could", "different", "document", "documents", "first", "ideas", "individual", "issue", "main", "method", "notes", "parts", "question", "relevant", "should", "these", "using", "what", "when", "which", "with", "your")
#: Markup skipped in pages, where main content is looked for, parts that are page chrome, lines that are controls.
SKIP_TAGS = ("script", "style", "nav", "footer", "header", "aside", "form", "noscript")
MAIN_PLACES = ("article", "main", ".markdown-body", ".post-content", ".entry-content", ".article-content", ".document", ".body", ".content", "#content", "#main", "#article")
CHROME_PARTS = ("sidebar", "breadcrumb", "toc", "table-of-contents", "search", "theme", "menu", "pagination", "related", "advert", "cookie", "banner")
UI_LINES = ("next", "previous", "search", "navigation", "theme", "auto", "light", "dark", "menu", "contents", "index", "next previous", "previous next", "light dark", "auto light dark", "show source", "view source")
MIN_PAGE_WORDS = 20
#: Patterns of JavaScript and TypeScript source, each with its name in group 1.
JS_IMPORTS = (
    r"import\s+.*?\s+from\s+['\"]([^'\"]+)['\"]",
    r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)",
    r"import\s*\(\s*['\"]([^'\"]+)['\"]\s*\)",
)
JS_FUNCTIONS = (
    r"(?:function\s+(\w+)\s*\()",
    r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\(",
    r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?function",
    r"(\w+)\s*\([^)]*\)\s*(?::\s*\w+\s*)?\{",
)
JS_CLASSES = (r"class\s+(\w+)",)
JS_DOC = r"(?s)/\*\*(.*?)\*/"
#: Where a JSON object names packages, dependencies and subjects: (kind, keys, most of each, shortest, longest).
JSON_HINTS = (
    ("library", ("name", "package", "module"), 1, 2, 60),
    ("dependency", ("dependencies", "devDependencies", "peerDependencies", "requires"), 25, 1, 1000),
    ("concept", ("keywords", "tags", "classifiers"), 20, 2, 40),
)
JSON_PROSE = ("summary", "description")
#: Subjects looked for in prose of metadata.
PROBED_CONCEPTS = ("API", "REST", "HTTP", "JSON", "GraphQL", "database", "semantic search", "knowledge graph", "machine learning", "data structure")
#: Types that content of each extension may have.
EXTENSION_MIMES = {
    "md": ("text/plain", "text/markdown", "text/x-markdown"),
    "txt": ("text/plain",),
    "pdf": ("application/pdf",),
    "docx": ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/zip"),
    "py": ("text/plain", "text/x-python", "application/x-python", "text/x-script.python"),
    "js": ("text/plain", "text/javascript", "application/javascript", "text/ecmascript", "application/json"),
    "ts": ("text/plain", "application/typescript", "text/typescript", "application/json", "text/x-c", "text/x-c++"),
    "json": ("application/json", "text/plain"),
    "csv": ("text/csv", "text/plain", "application/csv", "application/vnd.ms-excel"),
    "html": ("text/html", "text/plain"),
    "htm": ("text/html", "text/plain"),
}
#: Content types and size of pages that are read.
PAGE_TYPES = ("text/html", "application/xhtml+xml", "text/plain")
MAX_PAGE = 2 * 1024 * 1024
#: What questions ask for, by words that they hold.
COLLECTION_ASKED = ("summarize", "summary", "总结")
COLLECTION_MEANT = ("all file", "all document", "across", "所有")
FRAMEWORKS_ASKED = ("framework", "library", "libraries", "框架")
CONCEPTS_ASKED = ("main concept", "key concept", "主要概念", "核心概念")
DOCUMENT_ASKED = ("main content", "what is in", "what's in", "tell me about", "summarize", "summary of", "内容", "总结")

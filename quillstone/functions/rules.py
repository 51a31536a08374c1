"""Rules of the text miners. Results depend on each of them."""

# What a question or a problem looks like, in lower-cased text.
QUESTIONS = [
    r"\?", r"\bhow\s+(do|can|should|would|to)\b", r"\bwhy\s+(does|is|are|do|can|would)\b", r"\bwhat\s+(is|are|does|should|would)\b",
    r"\bwhere\s+(is|are|do|does|should)\b", r"\bcan\s+you\b", r"\bcould\s+you\b", r"\bhelp\s+(me|with)\b", r"\bfix\b", r"\berror\b",
    r"\bfailing\b", r"\bnot\s+working\b", r"\bdoesn't\s+work\b", r"\bproblem\b", r"\bissue\b", r"\bimplement\b",
    r"\badd\b.*\b(feature|function|method)\b", r"\bcreate\b.*\b(function|class|file)\b",
]
# Signs that an answer worked, and that it didn't.
THANKS = [
    r"\b(thanks|thank\s+you|perfect|great|works?|working)\b", r"\b(that('s)?|it('s)?)\s+(great|perfect|exactly|what\s+i)\b",
    r"^\s*(ok|okay|cool|nice|good|yes)\s*[.!]?\s*$",
]
CORRECTIONS = [r"\b(but|however|actually|still|doesn't|doesn't work)\b", r"\b(not quite|almost|close but)\b", r"\b(try again|one more|another)\b", r"\berror\b"]
# Tools that change code.
CODE_TOOLS = ["Edit", "Write", "NotebookEdit"]
# What a title loses from its start, in this order.
GREETINGS = [r"^(hi|hello|hey)[,!.]?\s*", r"^(can|could)\s+you\s+(please\s+)?", r"^(please\s+)?", r"^(i\s+(need|want)\s+(to|help)\s+)", r"^(help\s+me\s+)"]
# Topics by words of a content.
TOPICS = {
    "api": r"\b(api|endpoint|rest|graphql)\b", "database": r"\b(database|sql|query|table|migration)\b", "testing": r"\b(test|spec|assert|expect|mock)\b",
    "auth": r"\b(auth|login|password|token|jwt|oauth)\b", "config": r"\b(config|setting|environment|env)\b",
    "error-handling": r"\b(error|exception|try|catch|raise)\b", "performance": r"\b(performance|optimize|cache|speed)\b",
    "refactor": r"\b(refactor|clean|improve|simplify)\b",
}
# Languages of mined code, the first that matches.
CODE_LANGUAGES = {
    "python": [r"\bdef\s+\w+\(", r"\bimport\s+\w+", r"\bfrom\s+\w+\s+import\b", r"\bclass\s+\w+[:\(]"],
    "javascript": [r"\bconst\s+\w+\s*=", r"\blet\s+\w+\s*=", r"\bfunction\s+\w+\(", r"=>\s*\{"],
    "typescript": [r":\s*(string|number|boolean|any)\b", r"\binterface\s+\w+", r"<\w+>"],
    "go": [r"\bfunc\s+\w+\(", r"\bpackage\s+\w+", r"\bgo\s+(func|routine)\b"],
    "ruby": [r"\bdef\s+\w+\b(?!\()", r"\bend\b", r"\bdo\s*\|", r"\.rb\b"],
    "rust": [r"\bfn\s+\w+\(", r"\blet\s+mut\b", r"::\w+::"],
    "bash": [r"^\s*#!.*\b(ba)?sh\b", r"\b(export|echo|cd|ls|grep)\b", r"\$\{?\w+\}?"],
    "sql": [r"\b(SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER)\b"],
}
# Kinds of commits by conventional prefix.
PREFIXES = {
    "fix": "bug_fix", "bugfix": "bug_fix", "hotfix": "bug_fix", "feat": "feature", "feature": "feature", "refactor": "refactor", "perf": "performance",
    "docs": "documentation", "test": "testing", "chore": "maintenance", "style": "style", "build": "build", "ci": "ci",
}
# Kinds of commits by words; the kind with most matching patterns wins, the first of equals.
KINDS = {
    "bug_fix": [r"\bfix(?:e[sd])?\b", r"\bbug\b", r"\bissue\b", r"\bresolve[sd]?\b", r"\bcorrect(?:s|ed)?\b", r"\bpatch\b", r"\brepair\b", r"#\d+"],
    "feature": [r"\badd(?:s|ed|ing)?\b", r"\bimplement(?:s|ed|ing)?\b", r"\bintroduce[sd]?\b", r"\bnew\b", r"\bcreate[sd]?\b", r"\bsupport\b", r"\benable[sd]?\b"],
    "refactor": [
        r"\brefactor(?:ed|ing|s)?\b", r"\brestructure[sd]?\b", r"\breorganize[sd]?\b", r"\bclean\s*up\b", r"\bsimplify\b", r"\bextract(?:s|ed|ing)?\b",
        r"\brename[sd]?\b", r"\bmove[sd]?\b",
    ],
    "performance": [
        r"\bperformance\b", r"\boptimiz(?:e|ation)\b", r"\bspeed\s*up\b", r"\bfaster\b", r"\bcache[sd]?\b", r"\breduce\b.*\b(?:time|memory|latency)\b",
        r"\bimprove[sd]?\b.*\bperformance\b",
    ],
}
# Subjects that say nothing, and words that say little.
GENERIC = [
    r"^(?:wip|work in progress)$", r"^(?:update|updates)$", r"^(?:change|changes)$", r"^(?:fix|fixes)$", r"^(?:stuff|misc|various)$", r"^(?:todo|temp|tmp)$",
    r"^(?:commit|save|checkpoint)$", r"^(?:minor|small|quick)(?:\s+(?:fix|change|update))?$",
]
WEAK_WORDS = ["minor", "small", "quick", "temp", "wip"]
# Areas of a code base by path.
AREAS = {
    "api": r"(?:^|/)api/", "auth": r"(?:^|/)(?:auth|login|session)", "database": r"(?:^|/)(?:db|database|models?|migrations?)",
    "config": r"(?:^|/)(?:config|settings)", "tests": r"(?:^|/)tests?/", "cli": r"(?:^|/)(?:cli|commands?)/",
    "ui": r"(?:^|/)(?:ui|views?|templates?|components?)/",
}
# Labels in generated titles and descriptions.
TITLE_PREFIXES = {"bug_fix": "Fix:", "feature": "Feature:", "refactor": "Refactor:", "performance": "Performance:"}
KIND_NAMES = {
    "bug_fix": "Bug fix", "feature": "New feature", "refactor": "Code refactoring", "performance": "Performance improvement", "general": "Code change",
}
CHANGE_SIGNS = {"added": "+", "deleted": "-", "modified": "M", "renamed": "R"}
ELEMENT_PREFIXES = {"class": "Class:", "function": "Function:", "method": "Method:"}
# Architectural patterns by class name, file path and method names.
PATTERNS = {
    "repository": ([r"repo(?:sitory)?$", r"_repo$", r"Repo(?:sitory)?$"], [r"repositor", r"_repo\."], ["find", "get", "save", "delete", "create", "update", "all", "by"]),
    "service": ([r"service$", r"_service$", r"Service$", r"Svc$"], [r"service", r"_svc\."], ["execute", "process", "handle", "perform", "run"]),
    "factory": ([r"factory$", r"Factory$", r"_factory$"], [r"factor"], ["create", "make", "build", "new", "get_instance"]),
    "singleton": ([r"singleton$", r"Singleton$"], [r"singleton"], ["instance", "get_instance", "getInstance"]),
    "controller": ([r"controller$", r"Controller$", r"_controller$"], [r"controller"], ["index", "show", "create", "update", "destroy", "get", "post"]),
    "model": ([r"Model$", r"Entity$", r"_model$"], [r"models?/", r"entities/"], []),
    "middleware": ([r"middleware$", r"Middleware$"], [r"middleware"], ["before", "after", "around", "process", "handle"]),
    "handler": ([r"handler$", r"Handler$", r"_handler$"], [r"handler"], ["handle", "process", "on_", "dispatch"]),
}
# Titles and descriptions of these patterns.
PATTERN_TITLES = {
    "repository": "Repository Pattern", "service": "Service Layer Pattern", "factory": "Factory Pattern", "singleton": "Singleton Pattern",
    "controller": "Controller Pattern", "model": "Model/Entity Pattern", "middleware": "Middleware Pattern", "handler": "Handler Pattern",
}
PATTERN_ABOUT = {
    "repository": "Data access layer abstraction for database operations", "service": "Business logic layer for complex operations",
    "factory": "Object creation pattern for flexible instantiation", "singleton": "Single instance pattern for shared resources",
    "controller": "Request handling layer for HTTP endpoints", "model": "Data structure definitions and domain objects",
    "middleware": "Request/response pipeline processing", "handler": "Event or message processing pattern",
}
# Marks of comments that are worth keeping.
MARKERS = ["TODO", "FIXME", "NOTE", "HACK", "XXX", "BUG", "OPTIMIZE"]
# What a documentation string may have.
EXAMPLES, PARAMETERS, RETURNS = ["```", ">>>", "Example"], [":param", "@param", "Args:", "Parameters:"], [":return", "@return", "Returns:", "@returns"]
# Files that aren't scanned unless asked for.
EXCLUDES = [
    "*.min.js", "*.min.css", "*.bundle.js", "*.pyc", "*.pyo", "__pycache__/*", ".git/*", ".svn/*", ".hg/*", "node_modules/*", "vendor/*", "venv/*", ".venv/*",
    "env/*", ".env/*", "dist/*", "build/*", "*.egg-info/*", ".tox/*", ".pytest_cache/*", ".mypy_cache/*", ".coverage", "coverage/*", "htmlcov/*", "*.log", "*.lock",
]

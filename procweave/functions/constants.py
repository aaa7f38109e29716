"""Fixed values.

Everything in this module must equal the analysed tool's word lists, patterns,
weights and formats, otherwise results differ. They are stated plainly, in
their natural order, and used by the expression builders elsewhere.

Regex dialect: patterns run as Java regular expressions inside Spark. Flags
``(?i)`` / ``(?s)`` mirror the Python flags of the original; ``(?d)`` (Unix
lines) makes ``.`` and ``$`` treat only ``\\n`` as a line end, as Python does.
"""

# ---------------------------------------------------------------- fixed values
# Built-in SQL functions dropped from undotted call names (static analyser).
SQL_BUILTINS = [
    "TO_DATE", "TO_CHAR", "TO_NUMBER", "NVL", "NVL2", "COALESCE",
    "DECODE", "CASE", "CAST", "CONVERT", "COUNT", "SUM", "AVG",
    "MAX", "MIN", "SUBSTR", "SUBSTRING", "TRIM", "LTRIM", "RTRIM",
    "UPPER", "LOWER", "INITCAP", "LENGTH", "CONCAT", "REPLACE",
    "INSTR", "POSITION", "LPAD", "RPAD", "ROUND", "TRUNC", "FLOOR",
    "CEIL", "ABS", "MOD", "POWER", "SQRT", "SYSDATE", "CURRENT_DATE",
    "CURRENT_TIMESTAMP", "NOW", "GETDATE", "ADD_MONTHS", "MONTHS_BETWEEN",
    "NEXT_DAY", "LAST_DAY", "EXTRACT", "DATEPART", "DATEDIFF",
    "ROW_NUMBER", "RANK", "DENSE_RANK", "LAG", "LEAD", "FIRST_VALUE",
    "LAST_VALUE", "LISTAGG", "STRING_AGG", "GROUP_CONCAT",
]

# Short built-in list of the LLM analyser's regex fallback (applies to dotted names too).
SQL_BUILTINS_SHORT = [
    "TO_DATE", "TO_CHAR", "NVL", "DECODE", "COUNT",
    "SUM", "MAX", "MIN", "AVG", "SUBSTR", "TRIM",
]

# Keywords the relationship mapper ignores as call targets.
MAPPER_KEYWORDS = [
    "SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP",
    "BEGIN", "END", "IF", "THEN", "ELSE", "LOOP", "WHILE", "FOR",
    "DECLARE", "EXCEPTION", "WHEN", "RETURN", "RAISE", "COMMIT", "ROLLBACK",
    "SYSDATE", "SYSTIMESTAMP", "USER", "DUAL", "COUNT", "SUM", "MAX", "MIN",
    "AVG", "TO_CHAR", "TO_DATE", "TO_NUMBER", "SUBSTR", "LENGTH", "TRIM",
]

# Words the SQL guard rejects (whole words, checked in this order).
GUARD_BANNED = [
    "DROP", "DELETE", "UPDATE", "INSERT", "TRUNCATE",
    "ALTER", "CREATE", "EXEC", "EXECUTE", "CALL",
    "GRANT", "REVOKE", "COMMIT", "ROLLBACK",
]
GUARD_MSG_NOT_SELECT = "Apenas queries SELECT são permitidas"
GUARD_MSG_BANNED = "Comando '{kw}' não é permitido por segurança"
GUARD_MSG_MULTI = "Múltiplos comandos não são permitidos"

# Transformation functions recognised in field usage.
TRANSFORM_FUNCS = ["UPPER", "LOWER", "TRIM", "SUBSTR", "CONCAT", "REPLACE", "CAST"]

# Control structures, counted as repeated tokens.
CONTROL_KINDS = ["IF", "LOOP", "FOR", "WHILE", "CASE", "EXCEPTION"]

IDENT = r"[a-z_][a-z0-9_]*(?:\.[a-z_][a-z0-9_]*)?"

# Call patterns of the static analyser: EXEC/CALL, name(, pkg.name(.
CALL_PATTERNS = [
    r"(?i)(?:EXECUTE|EXEC|CALL)\s+(" + IDENT + ")",
    r"(?i)(" + IDENT + r")\s*\(",
    r"(?i)([a-z_][a-z0-9_]*\.[a-z_][a-z0-9_]*)\s*\(",
]
# Call patterns of the LLM analyser's regex fallback.
CALL_PATTERNS_SHORT = [
    r"(?i)(?:EXECUTE|EXEC|CALL)\s+(" + IDENT + ")",
    r"(?i)(" + IDENT + r")\s*\(",
]

# Table patterns: FROM, JOIN, INTO, UPDATE, DELETE FROM, MERGE INTO.
TABLE_PATTERNS = [
    r"(?i)FROM\s+(" + IDENT + ")",
    r"(?i)JOIN\s+(" + IDENT + ")",
    r"(?i)INTO\s+(" + IDENT + ")",
    r"(?i)UPDATE\s+(" + IDENT + ")",
    r"(?i)DELETE\s+FROM\s+(" + IDENT + ")",
    r"(?i)MERGE\s+INTO\s+(" + IDENT + ")",
]
# Table patterns of the LLM analyser's regex fallback (no JOIN, no MERGE).
TABLE_PATTERNS_SHORT = [
    r"(?i)FROM\s+(" + IDENT + ")",
    r"(?i)INTO\s+(" + IDENT + ")",
    r"(?i)UPDATE\s+(" + IDENT + ")",
    r"(?i)DELETE\s+FROM\s+(" + IDENT + ")",
]

SELECT_PATTERN = r"(?isd)SELECT\s+(.*?)\s+FROM"
INSERT_PATTERN = r"(?id)INSERT\s+INTO\s+\w+\s*\((.*?)\)"
UPDATE_PATTERN = r"(?isd)UPDATE\s+.*?SET\s+(.*?)(?:WHERE|$)"
TRANSFORM_PATTERN = r"(?i){func}\s*\(\s*([a-z_][a-z0-9_]*)"
PARAM_PATTERN = r"(?i)(\w+)\s+(IN|OUT|INOUT|IN\s+OUT)\s+([\w\(\)]+)"
VARIABLE_PATTERN = r"(?i)(v_\w+|l_\w+)\s+[\w\(\)]+;"
FIELD_NAME_PATTERN = r"^[A-Z_][A-Z0-9_]*$"
FUNC_ARG_PATTERN = r"\(([^)]+)\)"
SIGNATURE_PATTERN = r"(?i)\(\s*([^)]+)\s*\)"
SIGNATURE_SPLIT = r",(?![^(]*\))"
CONTEXT_CHARS = 100

# Code complexity heuristic.
COMPLEXITY_LINES_THRESHOLD = 50
COMPLEXITY_LINES_MAX_BONUS = 3
COMPLEXITY_IF_WEIGHT = 0.5
COMPLEXITY_LOOP_WEIGHT = 0.7
COMPLEXITY_CURSOR_WEIGHT = 0.8
COMPLEXITY_EXCEPTION_WEIGHT = 0.3
COMPLEXITY_MAX_SCORE = 10
# Text cuts before model calls.
MAX_CODE_LENGTH_BUSINESS_LOGIC = 2000
MAX_CODE_LENGTH_DEPENDENCIES = 3000
MAX_CODE_LENGTH_COMPLEXITY = 2000
MAX_CODE_LENGTH_PARAMETERS = 500
SCORE_IN_TEXT_PATTERN = r"\b([1-9]|10)\b"
SCORE_OUT_OF_RANGE_DEFAULT = 5

UNKNOWN_SCHEMA = "UNKNOWN"

# Relationship mapper: object kinds (folder names), file extension per kind, DOT colours.
OBJECT_KINDS = [
    "tables", "views", "procedures", "functions", "packages",
    "triggers", "sequences", "indexes", "constraints",
]
KIND_EXTENSION = {"procedures": ".prc", "functions": ".fnc"}  # every other kind: .sql
DEFAULT_EXTENSION = ".sql"
DOT_COLORS = {
    "tables": "lightblue",
    "views": "lightgreen",
    "procedures": "lightcoral",
    "functions": "lightyellow",
    "packages": "lightpink",
    "triggers": "lightgray",
    "sequences": "lightcyan",
    "indexes": "wheat",
    "constraints": "lavender",
}
CALLER_KINDS = ["procedures", "functions", "packages", "triggers"]

# Mapper reference patterns (applied to upper-cased text), with their relation type.
MAPPER_TABLE_PATTERNS = [
    (r"REFERENCES\s+[\"']?(\w+)[\"']?", "FOREIGN_KEY"),
    (r"FOREIGN\s+KEY.*?REFERENCES\s+[\"']?(\w+)[\"']?", "FOREIGN_KEY"),
    (r"FROM\s+[\"']?(\w+)[\"']?", "SELECT_FROM"),
    (r"JOIN\s+[\"']?(\w+)[\"']?", "JOIN"),
    (r"INSERT\s+INTO\s+[\"']?(\w+)[\"']?", "INSERT_INTO"),
    (r"UPDATE\s+[\"']?(\w+)[\"']?", "UPDATE"),
    (r"DELETE\s+FROM\s+[\"']?(\w+)[\"']?", "DELETE_FROM"),
    (r"CREATE\s+TRIGGER.*?ON\s+[\"']?(\w+)[\"']?", "TRIGGER_ON"),
]
MAPPER_CALL_EXPLICIT = r"(?:CALL|EXEC|EXECUTE)\s+(?:[\"']?(\w+)[\"']?\.)?[\"']?(\w+)[\"']?"
MAPPER_CALL_PAREN = r"\b([A-Z_][A-Z0-9_]*)\s*\("
MAPPER_CALL_MIN_LEN = 3
MAPPER_SEQUENCE = r"[\"']?(\w+)[\"']?\s*\.\s*(?:NEXTVAL|CURRVAL)"
MAPPER_PACKAGE_PROC = r"PROCEDURE\s+[\"']?(\w+)[\"']?"
MAPPER_PACKAGE_FUNC = r"FUNCTION\s+[\"']?(\w+)[\"']?"

# Complexity class and impact class thresholds.
COMPLEXITY_HIGH = 8
COMPLEXITY_MEDIUM = 5
IMPACT_HIGH_ABOVE = 10
IMPACT_MEDIUM_ABOVE = 5
IMPACT_LABELS = ("alta", "média", "baixa")

# Embedding document limits.
DOC_MAX_PARAMS = 10
DOC_MAX_CALLEES = 15
DOC_MAX_TABLES = 15
DOC_CODE_CHARS = 2000
NODE_DOC_MAX_COLUMNS = 15
NODE_DOC_MAX_FKS = 5
NODE_DOC_LOGIC_CHARS = 300
NODE_DOC_MAX_PARAMS = 10
EMBED_BATCH = 32

# Diagrams and reports.
MERMAID_MAX_NODES = 50
REPORT_TOP_N = 10
REPORT_MAX_RELATIONS = 100
PREVIEW_CHARS = 200
NEIGHBOURS_PER_TYPE = 10

# Query tools.
DEFAULT_QUERY_LIMIT = 100
MAX_QUERY_LIMIT = 1000
DEFAULT_SAMPLE = 10
MAX_SAMPLE = 100
CACHE_VERSION = "1.0"

# Mermaid output blocks (fixed text of the diagram exports).
MERMAID_CLASS_DEFS = (
    "\n"
    "    classDef high fill:#ff6b6b,stroke:#c92a2a,color:#fff\n"
    "    classDef medium fill:#ffd93d,stroke:#f59f00,color:#000\n"
    "    classDef low fill:#51cf66,stroke:#2b8a3e,color:#000\n"
    "```"
)
MERMAID_THEME_VARIABLES = (
    "  'theme': 'base',\n"
    "  'themeVariables': {\n"
    "    'fontSize': '16px',\n"
    "    'fontFamily': 'Arial, sans-serif',\n"
    "    'primaryColor': '#ff6b6b',\n"
    "    'primaryTextColor': '#fff',\n"
    "    'primaryBorderColor': '#c92a2a',\n"
    "    'lineColor': '#333',\n"
    "    'secondaryColor': '#ffd93d',\n"
    "    'tertiaryColor': '#51cf66'\n"
    "  },\n"
)
MERMAID_INIT_FLOWCHART = (
    "%%{init: {\n" + MERMAID_THEME_VARIABLES +
    "  'flowchart': {\n"
    "    'nodeSpacing': 50,\n"
    "    'rankSpacing': 80,\n"
    "    'curve': 'basis'\n"
    "  }\n"
    "}}%%"
)
MERMAID_INIT_ER = (
    "%%{init: {\n" + MERMAID_THEME_VARIABLES +
    "  'er': {\n"
    "    'entityPadding': 15,\n"
    "    'fill': '#fff',\n"
    "    'stroke': '#333'\n"
    "  }\n"
    "}}%%"
)
ER_MAX_PK = 3
ER_FIRST_COLUMNS = 5
ER_MAX_COLUMNS = 8
ER_TYPE_CHARS = 30

# Fallback DDL text of the Oracle and MySQL loaders when no DDL can be rebuilt.
PLACEHOLDER_DDL = "-- DDL para {schema}.{table}\n-- (Reconstruído a partir de metadados)"

# Headings and sentences of the relationship report, in the order of the report.
REPORT_TITLE = "# Mapa de Relacionamentos - Schema: "
REPORT_STATISTICS = "\n\n**Gerado em:** {generated_at}\n\n## Estatísticas\n\n- **Total de objetos:** "
REPORT_TOTAL_RELATIONS = "\n- **Total de relacionamentos:** "
REPORT_BY_KIND = "\n\n### Objetos por Tipo\n\n| Tipo | Quantidade |\n|------|------------|"
REPORT_TOP_REFERENCED = "\n### Objetos Mais Referenciados\n\n| Objeto | Referências |\n|--------|-------------|"
REPORT_TOP_REFERENCING = "\n### Objetos que Mais Referenciam Outros\n\n| Objeto | Referências |\n|--------|-------------|"
REPORT_ISOLATED = "\n### Objetos Isolados ("
REPORT_BY_TYPE = "\n### Relacionamentos por Tipo\n\n| Tipo | Quantidade |\n|------|------------|"
REPORT_RELATIONS = "\n## Relacionamentos\n\n| Origem | Tipo | Destino |\n|--------|------|---------|"
REPORT_SHOWN = "\n*Mostrando {shown} de "
REPORT_SHOWN_END = " relacionamentos. Ver arquivo JSON para lista completa.*"

# The sentence of a table without a purpose.
DEFAULT_PURPOSE = ("Tabela ", " com ", " colunas")

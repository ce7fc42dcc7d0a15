"""Limits, labels, word lists and patterns that decide results."""

# ---- fixed values: measurements and demographics ----
OUTLIER_LIMIT = 9999999
NO_MATCH = "No matching concept"
NULL_WORD = "NULL"
UNIT_DEFAULT = "NA"
PROGRAM_SOURCE = "PPI/PM"
PROGRAM_LABEL = "PPI"
RECORD_LABEL = "EHR"
DAYS_PER_YEAR = 365.24
AGE_EDGES = (34.5, 49.5, 64.5)
AGE_LABELS = ("<35", "35-49", "50-64", "65+")
QUARTILES = (0.0, 0.25, 0.5, 0.75, 1.0)
WHISKER_REACH = 1.5
SMALL_CELL = 20
PROFILE_ROWS = 10001

# ---- fixed values: results and limits ----
LARGE_RESULT = 1000
PREVIEW_ROWS = 100
PREVIEW_WIDTH = 50
MAX_RETRIES = 3
ERROR_LENGTH = 1000
ERROR_TAIL = "... (truncated)"
LIMITS = {"explore": 100, "aggregate": 1000, "all": None}

# ---- fixed values: text blocks ----
SQL_BLOCK = r"(?s)```sql[\s\x1c-\x1f\x85\p{Z}]*\n(.*?)```"
PLAIN_BLOCK = r"(?s)```[\s\x1c-\x1f\x85\p{Z}]*\n(.*?)```"
SQL_WORDS = ("SELECT", "WITH", "INSERT", "CREATE")
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
RULE_LINE = r"^[\s\x1c-\x1f\x85\p{Z}|+-]+$"
#: In whole texts: a line end or a pipe with the space around it, and all from the first row of a pipe table on.
CELL_EDGE = r"[\t\x0b\f\r\x1c-\x1f\x85\p{Z}]*+([\n|])[\t\x0b\f\r\x1c-\x1f\x85\p{Z}]*+"
FROM_FIRST_ROW = r"(?dm)^(?![\t\x0b\f\r\x1c-\x1f\x85\p{Z}|+-]*+(?:\n|\z))[^\n]*\|(?s:.*)"
ERROR_CODE = r"(?s)^(.*?)\p{Nd}{3}[\s\x1c-\x1f\x85\p{Z}]+"
CSV_AFTER = r"(?s)rows returned.*?\n\n(.*)"

# ---- fixed values: table description documents ----
DOCUMENT_KIND = "StructureDefinition"
TYPE_NAMES = {
    "string": "STRING",
    "code": "STRING",
    "integer": "INTEGER",
    "decimal": "FLOAT",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "dateTime": "TIMESTAMP",
    "instant": "TIMESTAMP",
}
TYPE_DEFAULT = "STRING"
MAPPING_IDENTITY = "vfig"
SENSITIVE_LABELS = ("UID", "PHI")

# ---- fixed values: dataset versions ----
VERSION_PATHS = {
    "wgsVcfMergedStoragePath": "WGS_VCF_MERGED_STORAGE_PATH",
    "wgsHailStoragePath": "WGS_HAIL_STORAGE_PATH",
    "wgsCramManifestPath": "WGS_CRAM_MANIFEST_PATH",
    "microarrayHailStoragePath": "MICROARRAY_HAIL_STORAGE_PATH",
    "microarrayVcfSingleSampleStoragePath": "MICROARRAY_VCF_SINGLE_SAMPLE_STORAGE_PATH",
    "microarrayVcfManifestPath": "MICROARRAY_VCF_MANIFEST_PATH",
    "microarrayIdatManifestPath": "MICROARRAY_IDAT_MANIFEST_PATH",
    "wgsVdsPath": "WGS_VDS_PATH",
    "wgsExomeMultiHailPath": "WGS_EXOME_MULTI_HAIL_PATH",
    "wgsExomeSplitHailPath": "WGS_EXOME_SPLIT_HAIL_PATH",
    "wgsExomeVcfPath": "WGS_EXOME_VCF_PATH",
    "wgsAcafThresholdMultiHailPath": "WGS_ACAF_THRESHOLD_MULTI_HAIL_PATH",
    "wgsAcafThresholdSplitHailPath": "WGS_ACAF_THRESHOLD_SPLIT_HAIL_PATH",
    "wgsAcafThresholdVcfPath": "WGS_ACAF_THRESHOLD_VCF_PATH",
    "wgsClinvarMultiHailPath": "WGS_CLINVAR_MULTI_HAIL_PATH",
    "wgsClinvarSplitHailPath": "WGS_CLINVAR_SPLIT_HAIL_PATH",
    "wgsClinvarVcfPath": "WGS_CLINVAR_VCF_PATH",
    "wgsLongReadsManifestPath": "LONG_READS_MANIFEST_PATH",
    "wgsLongReadsHailGRCh38": "WGS_LONGREADS_HAIL_GRCH38_PATH",
    "wgsLongReadsHailT2T": "WGS_LONGREADS_HAIL_T2T_PATH",
    "wgsLongReadsJointVcfGRCh38": "WGS_LONGREADS_JOINT_SNP_INDEL_VCF_GRCH38_PATH",
    "wgsLongReadsJointVcfT2T": "WGS_LONGREADS_JOINT_SNP_INDEL_VCF_T2T_PATH",
    "wgsCMRGVcfPath": "WGS_CMRG_VCF_PATH",
}
ENVIRONMENTS = ("test", "stable", "prod")
STATIC_VARIABLES = {
    "BIGQUERY_STORAGE_API_ENABLED": "true",
    "HG38_REFERENCE_FASTA": "gs://genomics-public-data/references/hg38/v0/Homo_sapiens_assembly38.fasta",
    "HG38_REFERENCE_FAI": "gs://genomics-public-data/references/hg38/v0/Homo_sapiens_assembly38.fasta.fai",
    "HG38_REFERENCE_DICT": "gs://genomics-public-data/references/hg38/v0/Homo_sapiens_assembly38.dict",
}
WORKSPACE_BUCKET_PREFIX = "gs://cloned-mybucket-"

# ---- fixed values: registry rows ----
APP_NAME_PATTERN = r"^[a-zA-Z0-9_-]+\z"
RESERVED_NAMES = ("_app", "health")
PORT_RANGE = (1, 65535)
TAIL_LINES = 100
STATUS_DEFAULT = "not_found"

# ---- fixed values: logs and activity ----
STARTUP_UNITS = ("devcontainer.service",)
SERVICE_UNITS = (
    "docker.service",
    "idle-shutdown.service",
    "proxy-prober.service",
    "proxy-readiness.service",
    "locksmithd.service",
    "update-engine.service",
)
STARTUP_TAG = "vm-journald-startup-logs"
SERVICE_TAG = "vm-journald-logs"
CONTAINER_TAG = "vm-docker-logs"
TAG_PATTERN = "vm-%"
FLUSH_INTERVAL = "5 seconds"
FORWARD_TEXT = "Forwarded request to backend"
FORWARD_TIME_FORMAT = "yyyy/MM/dd HH:mm:ss"
LOAD_THRESHOLD = 0.1
#: How far behind the latest activity mark another may come in (our own choice).
MARKS_LATE = "10 minutes"
ACTIVITY_KINDS = ("cpu", "proxy", "ssh", "boot")

# Messages of the registry rules.
RULE_MESSAGES = {
    "name": "app_name is required",
    "name_form": "app_name must contain only letters, numbers, hyphens, and underscores",
    "name_reserved": "app_name cannot be a reserved path",
    "user": "username is required",
    "home": "user_home_directory is required",
    "dockerfile": "dockerfile is required",
    "port": "port must be between 1 and 65535",
    "feature": "invalid optional feature: ",
}

# Fixed value: characters of a description in a table sheet.
SHEET_WIDTH = 60

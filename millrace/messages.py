"""Texts that users, logs and alerts match on."""

# These have to read exactly so.
STEP_FAILED = "Pipeline '{pipeline}' failed at step '{step}': {message}"
CHECKS_FAILED = "Data quality checks failed:"
FAILURE_LINE = "  - {line}"

NOT_NULL = "not_null: '{column}' has {observed} null rows"
UNIQUE = "unique: '{column}' has {observed} duplicates"
ROW_COUNT_MIN = "row_count_min: got {observed}, expected >= {expected}"
ACCEPTED_VALUES = "accepted_values: '{column}' has {observed} rows with invalid values"
CUSTOM_SQL = "custom_sql: got {observed}, expected {expected}"

NO_SOURCE = "Either source_path or source_config must be provided"
NO_MATCH = "Source path '{path}' matched no files"
DELIMITER_UNSURE = "Source file '{path}': its lines fit more than one delimiter, give the option 'sep'"
NO_DATASET = "Saved connector '{name}' not found"
NOT_PERMITTED = "run_as role '{role}' is not permitted to access: {paths}"
ACCESS_DENIED = "Access denied to: {paths}"

EMPTY_PARTITION = "partition_by: '{column}' has empty texts, which would be read back as null"
BAD_SIZE = "target_file_size must look like '200MB', '1GB', etc."
LOCAL_ZONE = "timezone must be a named IANA timezone, not 'localtime'"
BAD_ZONE = "timezone must be a valid IANA timezone, got {zone!r}"
NO_EMAIL = "email is required when on_failure is email"

UNCLOSED = "{where}: unclosed template in {text!r}"
STRAY_CLOSING = "{where}: unexpected closing delimiter in {text!r}"
BAD_TEMPLATE = "{where}: invalid template {token}"
UNKNOWN_VARIABLE = "{where}: unsupported template variable {name!r}"
EMPTY_FORMAT = "{where}: template {name!r} requires a non-empty format"
BAD_FORMAT = "{where}: invalid format for template {name!r}: {pattern!r}"

BAD_PLUGIN_NAME = "Invalid plugin name '{name}'"
UNKNOWN_PLUGIN = "Unknown transform plugin '{name}'. Available: {known}"
NOT_CALLABLE = "Plugin '{name}' does not expose a callable 'transform(table, params)'"
NOT_A_TABLE = "Plugin '{name}' must return a pyarrow.Table, got {kind}"

DUPLICATE_SOURCE = "Duplicate source type: '{name}'"
UNKNOWN_SOURCE = "Unknown source type: '{name}'. Available: {known}"

PROBE_NO_PATH = "No path provided"
PROBE_REMOTE = "Remote path configured: {path}"
PROBE_FOUND = "Found {files} file(s)"
PROBE_NO_MATCH = "No files matched: {path}"
PROBE_NO_URL = "No URL provided"
PROBE_OK = "HTTP {status} OK"
PROBE_HTTP_ERROR = "HTTP {status}: {reason}"
PROBE_TIMEOUT = "Connection timed out ({seconds}s)"
PROBE_REFUSED = "Connection failed: {reason}"
PROBE_ERROR = "Error: {reason}"

REQUEUED = "Recovered after crash (stale heartbeat)"
EXHAUSTED = "Failed after crash (stale heartbeat, no attempts left)"
STRAY_RETURN = "{path} has a carriage return within a line, outside quotes: name its line ends by lineSep"

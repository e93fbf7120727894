"""Column layouts of the frames and the domains of their text columns."""

from __future__ import annotations

VALUE = "struct<raw:string,normalized:string,type:string>"
ENVIRONMENT = "struct<profile:string,region:string,namespace:string>"
SOURCE = "struct<path:string,line:int,symbol:string,source_kind:string,scope:string>"
DETAILS = (
    "struct<type:string,default_value:string,raw_expression:string,prefix:string,bound_type:string,inferred_from_fields:boolean,"
    "from_constant:boolean,namespace:string,`group`:string,data_id:string,external_type:string,payload:string,reason:string,"
    "raw_text:string,known_prefix:string,known_suffix:string>"
)

FILES = "scan_id string, path string, name string, file_type string, scope string, content string"
#: Between the scan ids of a file that several scans share.
SHARED = "\u0001"
#: Configuration facts and uncertain accesses in one frame; ``kind`` is CONFIG or UNCERTAIN.
FINDINGS = (
    "scan_id string, ordinal bigint, kind string, key string, normalized_key string, role string, "
    f"value {VALUE}, default_value {VALUE}, expression string, reason string, root_sink string, "
    f"environment {ENVIRONMENT}, source {SOURCE}, confidence string, detector_id string, details {DETAILS}"
)
CHECKS = f"scan_id string, type string, severity string, message string, key string, source {SOURCE}"
DIAGNOSTICS = "scan_id string, severity string, phase string, message string, component_id string"
METRICS = "scan_id string, phase string, millis bigint, rows bigint"
CHANGES = "key string, field string, old_value string, new_value string, new_source string"
APP_CONFIGS = (
    "scope string, group_name string, config_key string, config_value string, secret int, "
    "sub_application_id string, version string, docker_version string, remark string"
)
METHOD_RULES = "id string, owner string, method string, key_arg int, default_arg int, value_arg int, confidence string, role string"
ANNOTATION_RULES = "id string, type string, key_attribute string, value_attribute string, default_attribute string, confidence string, role string"
FILE_RULES = "id string, pattern string, format string, scope string, rule_order int"
SCOPE_RULES = "profile string, profile_pattern string, is_default boolean, scope string, rule_order int"

DOMAINS = {
    "role": ("DEFINE", "READ", "CONDITION", "METADATA"),
    "value_type": ("STRING", "INTEGER", "BOOLEAN", "DURATION", "PLACEHOLDER", "UNKNOWN"),
    "confidence": ("HIGH", "MEDIUM", "LOW"),
    "scope": ("MAIN", "TEST", "RUNTIME", "BUILD", "UNKNOWN"),
    "severity": ("INFO", "WARNING", "ERROR"),
}

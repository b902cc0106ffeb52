"""Rule tables: patterns, word lists, mappings and thresholds.

Everything below is a fixed value that results depend on; the operators take these tables
as defaults and accept others.
"""

from __future__ import annotations

from typing import NamedTuple

# --------------------------------------------------------------------------- areas
# Metric of a detection -> coverage area, and the area of other metrics.
METRIC_TO_AREA = {
    "network_presence": "network_coverage",
    "endpoint_identity": "endpoint_coverage",
    "identity_context": "identity_coverage",
    "application_telemetry": "application_coverage",
    "cloud_infrastructure": "cloud_coverage",
}
DEFAULT_AREA = "application_coverage"
METRICS = list(METRIC_TO_AREA)
AREAS = list(METRIC_TO_AREA.values())


# ------------------------------------------------------------------------ detectors
class Detector(NamedTuple):
    name: str
    area: str
    pattern: str
    needs: str = ""  # literal a text must hold before the pattern can match
    ignore_case: bool = True
    family: str = ""
    multiplier: float = 1.0
    description: str = ""


# General detectors by metric. Two are changed, for these reasons:
# - fqdn has to hold a dot and an alphabetic top level, otherwise it would match every word;
# - email starts with a word character, so that the leading boundary can be tested by a look-behind
#   that knows accented letters, and its top level has no "|".
DETECTORS = [
    Detector("ipv4", "network_presence", r"(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)", "."),
    Detector("ipv6", "network_presence", r"(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}", ":"),
    Detector("fqdn", "network_presence", r"\b(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,63}\b", "."),
    Detector("ports", "network_presence", r":\d{1,5}\b", ":"),
    Detector("hostname_enterprise", "endpoint_identity", r"\b[A-Z]{2,4}-[A-Z0-9]+-\d+\b", "-"),
    Detector("hostname_workstation", "endpoint_identity", r"\bWS-[A-Z0-9]+-\d+\b", "-"),
    Detector("hostname_server", "endpoint_identity", r"\bSRV-[A-Z0-9]+-\d+\b", "-"),
    Detector("device_guid", "endpoint_identity", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "-"),
    Detector("email", "identity_context", r"\b[A-Za-z0-9_][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "@"),
    Detector("domain_user", "identity_context", r"\b[A-Za-z0-9_-]+\\[A-Za-z0-9_.-]+\b", "\\"),
    Detector("logon_event", "identity_context", r"\b(?:4624|4625|4648|4672|4768|4769|4776|4778|4779)\b"),
    Detector("http_status", "application_telemetry", r"\b[1-5][0-9]{2}\b"),
    Detector("api_endpoint", "application_telemetry", r"/api/[a-zA-Z0-9/_-]+", "/"),
    Detector("url_path", "application_telemetry", r"https?://[^\s]+", "://"),
    Detector("aws_instance", "cloud_infrastructure", r"\bi-[0-9a-f]{8,17}\b", "-"),
    Detector("aws_volume", "cloud_infrastructure", r"\bvol-[0-9a-f]{8,17}\b", "-"),
    Detector("region_code", "cloud_infrastructure", r"\b(?:us|eu|ap|ca)-(?:east|west|central|north|south)-[0-9][a-z]?\b", "-"),
]


def _code(family: str, name: str, pattern: str, area: str, multiplier: float, description: str, needs: str = "") -> Detector:
    # Code-like patterns compare case: ignoring it they match ordinary words.
    return Detector(name, area, pattern, needs, False, family, multiplier, description)


# Industry identifiers by family, with the confidence multiplier of each. The tail of
# iban is changed from `([A-Z0-9]?){0,16}`: the same texts match, but a repetition of what may be
# empty takes exponential time on long codes.
INDUSTRY_DETECTORS = [
    _code("financial", "swift_code", r"\b[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?\b", "identity_context", 1.5, "SWIFT bank codes"),
    _code("financial", "iban", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{4}[0-9]{7}[A-Z0-9]{0,16}\b", "identity_context", 1.8, "IBAN numbers"),
    _code("financial", "card_number", r"\b4[0-9]{12}(?:[0-9]{3})?\b", "identity_context", 2.0, "Credit card numbers"),
    _code("financial", "trading_symbol", r"\b[A-Z]{1,5}:[A-Z]{1,8}\b", "application_telemetry", 1.3, "Trading symbols", ":"),
    _code("healthcare", "patient_id", r"\bPT[0-9]{6,8}\b", "identity_context", 1.7, "Patient identifiers", "PT"),
    _code("healthcare", "medical_record", r"\bMRN[0-9]{6,10}\b", "identity_context", 1.8, "Medical record numbers", "MRN"),
    _code("healthcare", "npi", r"\b[0-9]{10}\b", "identity_context", 1.6, "National Provider Identifier"),
    _code("healthcare", "phi_marker", r"\b(?:SSN|DOB|MRN|PHI|HIPAA)\b", "identity_context", 1.4, "PHI indicators"),
    _code("retail", "customer_id", r"\bCUST[0-9]{6,10}\b", "identity_context", 1.4, "Customer IDs", "CUST"),
    _code("retail", "order_id", r"\bORD[0-9A-F]{6,12}\b", "application_telemetry", 1.3, "Order identifiers", "ORD"),
    _code("retail", "sku", r"\b[A-Z]{2,4}[0-9]{4,8}\b", "application_telemetry", 1.2, "Product SKUs"),
    _code("retail", "barcode", r"\b[0-9]{8,14}\b", "application_telemetry", 1.1, "Product barcodes"),
    _code("manufacturing", "asset_tag", r"\bAT[0-9]{6,10}\b", "endpoint_identity", 1.6, "Asset tags", "AT"),
    _code("manufacturing", "serial_number", r"\bSN[A-Z0-9]{8,12}\b", "endpoint_identity", 1.5, "Serial numbers", "SN"),
    _code("manufacturing", "lot_number", r"\bLOT[0-9A-F]{6,10}\b", "application_telemetry", 1.3, "Manufacturing lots", "LOT"),
    _code("energy", "meter_id", r"\bMTR[0-9]{6,12}\b", "endpoint_identity", 1.5, "Meter identifiers", "MTR"),
    _code("energy", "scada_tag", r"\b[A-Z]{2,4}_[0-9]{3,6}\b", "endpoint_identity", 1.7, "SCADA tags", "_"),
    _code("energy", "grid_node", r"\bGN[0-9]{4,8}\b", "network_presence", 1.6, "Grid nodes", "GN"),
]

# Compliance identifiers by framework.
COMPLIANCE_DETECTORS = [
    _code("pci_dss", "card_data", r"\b4[0-9]{12}(?:[0-9]{3})?\b", "identity_context", 2.0, "Payment card data"),
    _code("pci_dss", "cardholder_data", r"\bCHD[0-9]{6,10}\b", "identity_context", 1.8, "Cardholder data", "CHD"),
    _code("sox", "financial_control", r"\bFC[0-9]{4,8}\b", "application_telemetry", 1.5, "Financial controls", "FC"),
    _code("sox", "audit_trail", r"\bAT[0-9]{6,10}\b", "application_telemetry", 1.6, "Audit trails", "AT"),
    _code("gdpr", "eu_citizen_id", r"\b[A-Z]{2}[0-9]{6,12}\b", "identity_context", 1.7, "EU citizen IDs"),
    _code("gdpr", "consent_record", r"\bCON[0-9A-F]{8,12}\b", "identity_context", 1.5, "Consent records", "CON"),
]

# Loose host, network and platform matchers. Off by default, they match much. Their
# flag to ignore case is the field of that name.
VARIANT_DETECTORS = [
    Detector("host_generic", "host_identifiers", r"([a-z]{2,4}[\-_]?)?(srv|server|host|node|machine|system|device|endpoint|workstation|computer|pc|ws|wks|laptop|desktop|vm|instance)[\-_]?([a-z]{0,8}[\-_]?)?(\d{1,6})?(\.[a-z]{2,8})*"),
    Detector("host_compound", "host_identifiers", r"[a-z]{1,63}[\-_\.]{1,3}[a-z]{1,63}[\-_\.]{0,3}([a-z]{0,63})?(\.(local|corp|internal|company))?"),
    Detector("host_guid", "host_identifiers", r"[0-9a-f]{8}[\-]?[0-9a-f]{4}[\-]?[0-9a-f]{4}[\-]?[0-9a-f]{4}[\-]?[0-9a-f]{12}"),
    Detector("host_role", "host_identifiers", r"(mailsvr|build-agent|analytics-node|exec-laptop|orchestrator|perimeter-fw)"),
    Detector("host_site_code", "host_identifiers", r"[A-Z]{2,4}-[A-Z]{2,10}-\d{2,6}", "-"),
    Detector("net_ipv4_cidr", "network_entities", r"\b((25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)(/[0-9]{1,2})?\b", "."),
    Detector("net_ipv6", "network_entities", r"\b([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b", ":"),
    Detector("net_name", "network_entities", r"(([a-z0-9]([a-z0-9\-]{0,61}[a-z0-9])?\.)*[a-z0-9]([a-z0-9\-]{0,61}[a-z0-9])?)"),
    Detector("net_interface", "network_entities", r"(eth0|ens3|bond0|mgmt|wifi|vpn|cni|flannel):[0-9\.:]+", ":"),
    Detector("net_socket", "network_entities", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}:[0-9]{1,5}", ":"),
    Detector("os_windows", "platform_systems", r"(microsoft\s+)?(windows\s*)?(server\s*)?(20(08|12|16|19|22)|10|11|xp|vista|7|8)"),
    Detector("os_redhat", "platform_systems", r"(red\s*hat\s*)?(enterprise\s*)?(linux|rhel)(\s*[0-9](\.[0-9])*)?"),
    Detector("os_linux", "platform_systems", r"(ubuntu|debian|centos|fedora|suse)(\s*[0-9]{1,2}(\.[0-9]{1,2})*)?"),
    Detector("os_unix", "platform_systems", r"(unix|aix|solaris|hp\-ux|freebsd)(\s*[0-9](\.[0-9])*)?"),
    Detector("os_mac", "platform_systems", r"(mac\s*os|macos|osx|darwin)"),
    Detector("os_hypervisor", "platform_systems", r"(vmware|esxi|hyper\-v|citrix|xen)"),
    Detector("os_build", "platform_systems", r"(win2019|ubuntu-20|rhel8|macos-monterey|container-os|cisco-asa)"),
]

# Column names that hint at each of the three variant groups.
VARIANT_HINTS = {
    "host_identifiers": ["asset_reference", "primary_fqdn", "machine_identity", "device_uuid", "endpoint_guid", "system_identifier", "hardware_fingerprint", "unique_id", "principal_name", "subject_identifier", "resource_name", "target_system", "source_host", "sensor_id"],
    "network_entities": ["origin_addr", "destination_addr", "client_source", "interface_config", "network_config", "connection_point", "network_node", "routing_destination", "packet_source"],
    "platform_systems": ["platform_build", "os_build", "compute_spec", "runtime_system", "system_kernel", "platform_version", "os_family", "system_architecture"],
}

# Compliance regimes that matter for an industry family, and the default.
FAMILY_REGIMES = {
    "financial": ["SOX", "PCI_DSS", "GDPR", "Basel_III"],
    "healthcare": ["HIPAA", "GDPR", "HITECH"],
    "retail": ["PCI_DSS", "GDPR", "CCPA"],
    "manufacturing": ["ISO27001", "NIST", "GDPR"],
    "energy": ["NERC_CIP", "ICS_CERT", "NIST"],
}
DEFAULT_REGIMES = ["ISO27001", "NIST"]

# ------------------------------------------------------------------- coverage roles
# Log types and source-type patterns of three monitoring roles.
ROLE_LOG_TYPES = {
    "Network": ["Firewall Traffic", "IDS/IPS", "NDR", "Proxy", "DNS", "WAF"],
    "Endpoint": ["OS logs (WinEVT, Linux syslog)", "EDR", "DLP", "FIM"],
    "Cloud": ["Cloud Event", "Cloud Load Balancer", "Cloud Config", "Theom", "Wiz", "Cloud Security"],
}
ROLE_SOURCE_TYPES = {
    "Network": ["%firewall%", "%proxy%", "%dns%"],
    "Endpoint": ["%windows%", "%linux%", "%endpoint%"],
    "Cloud": ["%cloud%", "%aws%", "%azure%"],
}

# --------------------------------------------------------------------------- catalog
# Schemas and table names a catalog listing leaves out.
SYSTEM_SCHEMAS = ["INFORMATION_SCHEMA", "information_schema", "__TABLES__", "sys"]
SCRATCH_TABLES = ["%\\_BACKUP\\_%", "temp\\_%"]

# ------------------------------------------------------------------------- profiling
# Value formats reported when more than 80 % of the values match.
FORMATS = {
    "email": r"(?i)^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "ip_address": r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$",
    "uuid": r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "timestamp": r"(?i)^[0-9]{4}-[0-9]{2}-[0-9]{2}[\sT][0-9]{2}:[0-9]{2}:[0-9]{2}",
    "url": r"(?i)^https?://[^\s]+$",
    "phone": r"^\+?1?[-.\s]?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}$",
}
FORMAT_SHARE = 0.8
# Shortest and longest text each format can have, and a literal it has to hold.
FORMAT_LENGTHS = {"email": (6, None), "ip_address": (7, 15), "uuid": (36, 36), "timestamp": (19, None), "url": (8, None), "phone": (10, 17)}
FORMAT_NEEDS = {"email": "@", "ip_address": ".", "timestamp": "-", "url": "://"}

# Words in a column name that mark a time column.
TIME_WORDS = ["time", "date", "timestamp", "created", "modified"]

# Semantic types in priority order, with their patterns and relevance.
SEMANTIC_PATTERNS = {
    "hostname": [r".*\.(?:com|net|org|local)$", r"^(?:web|db|mail|server)"],
    "ip_address": [r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$"],
    "security_event": [r"\b(?:alert|error|warning|critical|threat)\b"],
    "user_identity": [r"\b(?:user|username|account|identity)\b"],
    "asset_id": [r"\b(?:asset|device|computer).*id\b"],
    "log_data": [r"\b(?:log|event|audit|syslog)\b"],
    "network_device": [r"\b(?:firewall|router|switch|proxy)\b"],
    "application": [r"\b(?:web|http|api|service|app)\b"],
    "time_field": [r"\b(?:time|date|timestamp|created)\b"],
    "location": [r"\b(?:country|region|city|location|site)\b"],
}
SEMANTIC_RELEVANCE = {
    "hostname": 0.9, "ip_address": 0.9, "security_event": 0.95, "user_identity": 0.85, "asset_id": 0.9,
    "log_data": 0.8, "network_device": 0.8, "application": 0.7, "time_field": 0.7, "location": 0.6,
}
DEFAULT_RELEVANCE = 0.3

# The six field requirements and the semantic types that serve each.
REQUIREMENTS = {
    "asset_coverage": ["hostname", "asset_id", "ip_address"],
    "security_controls": ["security_event", "log_data"],
    "network_visibility": ["network_device", "ip_address", "hostname"],
    "endpoint_coverage": ["hostname", "asset_id"],
    "log_compliance": ["log_data", "security_event", "time_field"],
    "identity_tracking": ["user_identity", "security_event"],
}

# ---------------------------------------------------------------- field classification
# Log role of a column by word, first role wins.
ROLE_WORDS = {
    "network": ["ip", "port", "protocol", "dns", "url", "firewall", "proxy", "traffic", "packet"],
    "endpoint": ["host", "system", "file", "process", "registry", "event", "endpoint"],
    "cloud": ["cloud", "instance", "resource", "vpc", "gcp", "aws", "azure"],
    "application": ["app", "web", "api", "http", "request", "response", "session"],
    "identity_authentication": ["user", "auth", "login", "credential", "identity", "account"],
}
# Log types and common field names in priority order; parts split at "_".
LOG_TYPES = [
    "firewall_traffic", "ids_ips", "ndr", "proxy", "dns", "waf",
    "os_logs", "edr", "dlp", "fim",
    "cloud_event", "cloud_load_balancer", "cloud_config", "theom", "wiz", "cloud_security",
    "web_logs", "api_gateway",
    "authentication_attempts", "privilege_escalation", "identity_lifecycle",
]
COMMON_FIELDS = [
    "ip_source", "ip_target", "protocol", "detection_signature", "port", "dns_record_fqdn", "http_headers",
    "system_name", "ip", "filename",
    "instance_id", "resource_id", "vpc_id",
    "user_agent", "session_id", "endpoint_path",
    "username", "domain", "group",
]
# Visibility factors, infrastructure types and privacy levels by word.
FACTOR_WORDS = {
    "url_fqdn_coverage": ["url", "fqdn", "domain", "hostname"],
    "cmdb_asset_visibility": ["asset", "host", "system", "device"],
    "ipam_public_ip_coverage": ["ip", "address"],
    "network_zones_spans": ["zone", "span", "segment"],
    "geolocation": ["geo", "location", "country", "region"],
    "vpc": ["vpc", "cloud"],
    "log_ingest_volume": ["log", "event", "record"],
}
INFRA_WORDS = {
    "cloud": ["cloud", "gcp", "aws", "azure"],
    "saas": ["saas", "service"],
    "api": ["api", "gateway"],
}
PRIVACY_WORDS = {
    "restricted": ["email", "phone", "ssn", "name", "address", "birth", "passport", "license"],
    "confidential": ["password", "secret", "token", "key", "hash", "credential"],
    "internal": ["user", "person", "individual"],
}
# What a column holds, how much it matters, and how it relates to threats.
CONTENT_WORDS = {
    "ip_address": ["ip", "addr", "address"],
    "timestamp": ["time", "date", "timestamp", "created", "modified"],
    "identifier": ["id", "uuid", "key", "guid"],
    "user_info": ["user", "username", "account", "email"],
    "network_info": ["port", "protocol", "dns", "url"],
    "system_info": ["host", "system", "device", "machine"],
    "security_event": ["event", "alert", "incident", "threat"],
    "file_info": ["file", "path", "filename", "directory"],
}
SIGNIFICANCE_WORDS = {
    "critical": ["id", "key", "primary", "main", "core"],
    "high": ["time", "user", "system", "event", "alert"],
    "medium": ["description", "details", "info", "data"],
    "low": ["comment", "note", "misc", "other"],
}
THREAT_WORDS = {
    "high": ["malware", "attack", "threat", "intrusion", "breach"],
    "medium": ["suspicious", "anomaly", "violation", "unauthorized"],
    "standard": ["event", "log", "activity", "behavior"],
}
DEPENDENT_FIELDS = {
    "source": ["destination", "target", "protocol"],
    "user": ["session", "authentication", "domain"],
    "event": ["timestamp", "severity", "source"],
    "file": ["path", "hash", "size"],
    "process": ["pid", "user", "command"],
}
CORRELATION_WORDS = {
    "high": ["id", "key", "timestamp", "user"],
    "medium": ["ip", "host", "session"],
}
# What each log role is good for.
ROLE_PURPOSE = {
    "network": "monitors network traffic for security policy enforcement and threat detection",
    "endpoint": "tracks endpoint activities for malware detection and system monitoring",
    "cloud": "monitors cloud infrastructure for security compliance and threat detection",
    "application": "tracks application behavior for security monitoring and performance analysis",
    "identity_authentication": "manages user authentication and access control for security",
}
ROLE_VALUE = {
    "network": "protects business infrastructure through network security monitoring",
    "endpoint": "secures business endpoints and prevents data breaches",
    "cloud": "ensures cloud infrastructure security and compliance",
    "application": "protects business applications and customer data",
    "identity_authentication": "secures business access and prevents unauthorized use",
}
ROLE_COMPLIANCE = {
    "network": "supports PCI DSS and network security compliance",
    "endpoint": "enables GDPR and endpoint security compliance",
    "identity_authentication": "satisfies SOX and access control mandates",
    "application": "supports OWASP and application security standards",
    "cloud": "ensures cloud security compliance and governance",
}
ROLE_RISK = {
    "network": "mitigates network intrusion and data exfiltration risks",
    "endpoint": "reduces endpoint compromise and malware risks",
    "identity_authentication": "prevents unauthorized access and insider threats",
    "application": "reduces application vulnerabilities and attack risks",
    "cloud": "mitigates cloud security and configuration risks",
}
# Labels for scoring column content, table themes and column meaning.
CONTENT_LABELS = [
    "network_security_data", "user_authentication_data", "system_event_data", "application_performance_data",
    "threat_intelligence_data", "compliance_audit_data", "infrastructure_monitoring_data", "business_analytics_data",
]
THEME_LABELS = [
    "cybersecurity_monitoring", "network_traffic_analysis", "user_behavior_tracking", "system_performance_monitoring",
    "threat_detection_response", "compliance_reporting", "infrastructure_management", "business_intelligence",
]
MEANING_LABELS = [
    "stores network traffic information", "contains authentication data", "holds system event details",
    "tracks user activity", "records security incidents", "monitors application behavior",
    "stores configuration settings", "contains threat intelligence", "tracks asset information", "holds compliance data",
]

# ---------------------------------------------------------------------------- lineage
# Layer of a table by name fragment, first layer wins.
LAYER_WORDS = {
    "staging": ["stg_", "staging_", "raw_"],
    "intermediate": ["int_", "intermediate_", "temp_"],
    "mart": ["mart_", "dim_", "fact_", "agg_"],
    "reporting": ["rpt_", "report_", "dashboard_"],
}

# -------------------------------------------------------------------------- readiness
# Requirements of four compliance frameworks and the area that meets each.
FRAMEWORKS = {
    "SOC2": ["network_monitoring", "access_logging", "system_monitoring", "change_management"],
    "ISO27001": ["asset_inventory", "access_control", "incident_detection", "risk_management"],
    "NIST_CSF": ["identify", "protect", "detect", "respond", "recover"],
    "PCI_DSS": ["network_segmentation", "access_control", "monitoring", "encryption"],
}
REQUIREMENT_TO_AREA = {
    "network_monitoring": "network_coverage",
    "access_logging": "identity_coverage",
    "system_monitoring": "endpoint_coverage",
    "change_management": "application_coverage",
    "asset_inventory": "endpoint_coverage",
    "access_control": "identity_coverage",
    "incident_detection": "application_coverage",
    "risk_management": "application_coverage",
    "identify": "endpoint_coverage",
    "protect": "identity_coverage",
    "detect": "application_coverage",
    "respond": "application_coverage",
    "recover": "cloud_coverage",
    "network_segmentation": "network_coverage",
    "monitoring": "application_coverage",
    "encryption": "application_coverage",
}
# Readiness status by score, and the timeline that goes with each status.
STATUS_BANDS = [(0.8, "READY"), (0.6, "NEARLY_READY"), (0.4, "PARTIAL")]
TIMELINES = {
    "READY": ["2-4 weeks", "8-12 weeks", "3 months"],
    "NEARLY_READY": ["4-6 weeks", "12-16 weeks", "4-5 months"],
    "PARTIAL": ["6-8 weeks", "16-24 weeks", "6-8 months"],
    "NOT_READY": ["8-12 weeks", "24-36 weeks", "9-12 months"],
}
ADVICE = {
    "READY": "Start now: the data foundation is strong",
    "NEARLY_READY": "Start now and close the known collection gaps on the way",
    "PARTIAL": "Improve the data infrastructure before the full rollout",
    "NOT_READY": "Collect significantly more data first",
}
HIGH_RISK_AREAS = ["network_coverage", "identity_coverage"]
AREA_DEPENDENCIES = {
    "network_coverage": "Network monitoring infrastructure",
    "identity_coverage": "Identity and access management integration",
    "endpoint_coverage": "Endpoint detection and response tools",
}

# ------------------------------------------------------------------------- operations
# Error categories by word in the message, first category wins.
SCAN_ERROR_WORDS = {
    "permission_denied": ["permission", "forbidden"],
    "quota_exceeded": ["quota", "limit"],
    "not_found": ["not found", "404"],
    "network_error": ["network", "timeout"],
}
SCAN_RETRY_WORDS = {
    "permission": ["permission", "forbidden", "403"],
    "quota": ["quota", "limit", "429"],
    "network": ["network", "connection", "timeout"],
}
CALL_ERROR_WORDS = {
    "quota_exceeded": ["quota", "limit", "rate limit", "429"],
    "permission_denied": ["permission", "forbidden", "403", "access denied"],
    "network_timeout": ["timeout", "connection", "network"],
    "internal_error": ["500", "internal", "server error"],
}
# Alert bounds.
SLOW_SECONDS = 30.0
LOW_ROWS_PER_SECOND = 100.0
HIGH_ERROR_PERCENT = 10.0
MAX_CONCURRENT = 50

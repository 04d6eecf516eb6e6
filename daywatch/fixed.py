"""Fixed values. They must equal the published ones for results to agree."""

# --- Fixed values: input logs -------------------------------------------------
LOG_COLUMNS = {
    "logon": ["date", "user", "pc", "activity"],
    "file": ["date", "user", "pc", "activity", "filename"],
    "device": ["date", "user", "pc", "activity"],
    "email": ["date", "user", "pc", "to", "attachments"],
    "http": ["date", "user", "pc", "url", "activity"],
}
WORK_HOURS = (9, 17)
LATE_NIGHT = (22, 5)
RUN_GAP_MINUTES = 30
INTERNAL_EMAIL_DOMAIN = "dtaa.com"
LONG_URL_LENGTH = 90
JOB_DOMAINS = [
    "careerbuilder.com",
    "indeed.com",
    "monster.com",
    "simplyhired.com",
    "linkedin.com",
    "www.linkedin.com",
]
CLOUD_STORAGE_DOMAINS = [
    "dropbox.com",
    "www.dropbox.com",
    "drive.google.com",
    "docs.google.com",
    "yousendit.com",
    "www.yousendit.com",
]
SUSPICIOUS_DOMAINS = ["wikileaks.org", "www.wikileaks.org"]

# --- Fixed values: role weights -----------------------------------------------
ROLE_SENSITIVITY = {
    "President": 1.00,
    "VicePresident": 0.95,
    "Director": 0.90,
    "ITAdmin": 0.90,
    "Accountant": 0.85,
    "FinancialAnalyst": 0.85,
    "Attorney": 0.80,
    "Economist": 0.80,
    "Manager": 0.75,
    "ProjectManager": 0.75,
    "LabManager": 0.70,
    "HumanResourceSpecialist": 0.70,
    "Supervisor": 0.65,
    "ComputerScientist": 0.50,
    "Physicist": 0.50,
    "Mathematician": 0.50,
    "Statistician": 0.50,
    "Scientist": 0.50,
    "SoftwareDeveloper": 0.50,
    "SoftwareEngineer": 0.50,
    "WebDeveloper": 0.50,
    "ComputerProgrammer": 0.50,
    "PurchasingClerk": 0.45,
    "SystemsEngineer": 0.45,
    "SoftwareQualityEngineer": 0.45,
    "ChiefEngineer": 0.45,
    "HardwareEngineer": 0.40,
    "ElectricalEngineer": 0.40,
    "MechanicalEngineer": 0.40,
    "MaterialsEngineer": 0.40,
    "IndustrialEngineer": 0.40,
    "HealthSafetyEngineer": 0.40,
    "TestEngineer": 0.40,
    "FieldServiceEngineer": 0.40,
    "Engineer": 0.40,
    "SecurityGuard": 0.40,
    "Nurse": 0.40,
    "NursePractitioner": 0.40,
    "Salesman": 0.35,
    "Technician": 0.35,
    "TechnicalWriter": 0.35,
    "InstructionalCoordinator": 0.30,
    "ProductionLineWorker": 0.30,
    "StockroomClerk": 0.30,
    "AdministrativeAssistant": 0.30,
    "AdministrativeStaff": 0.30,
}
FINANCE_DEPARTMENTS = [
    "1 - Accounting",
    "2 - Payroll",
    "3 - FinancialPlanning",
    "2 - Pricing",
]
FINANCE_FLOOR = 0.70
DEFAULT_SENSITIVITY = 0.5

# --- Fixed values: feature lists ----------------------------------------------
SUM_FEATURES = [
    "logon_count", "logoff_count", "off_hours_logon", "logon_late_night_count",
    "file_open_count", "file_write_count", "file_copy_count", "file_delete_count",
    "off_hours_files_accessed", "file_late_night_count",
    "usb_insert_count", "usb_remove_count", "off_hours_usb_usage", "device_late_night_count",
    "emails_sent", "external_emails_sent", "attachments_sent", "off_hours_emails",
    "email_late_night_count",
    "http_total_requests", "http_visit_count", "http_download_count", "http_upload_count",
    "http_jobsite_visits", "http_cloud_storage_visits", "http_suspicious_site_visits",
    "off_hours_http_requests", "http_long_url_count", "http_late_night_count",
]
MAX_FEATURES = [
    "pc_seen_before", "new_pc_after_stable_history",
    "logon_hourly_entropy", "logon_peak_hour_count", "logon_longest_active_run_minutes",
    "file_hourly_entropy", "file_peak_hour_count", "file_longest_active_run_minutes",
    "device_hourly_entropy", "device_longest_active_run_minutes",
    "email_hourly_entropy", "email_peak_hour_count",
    "http_hourly_entropy", "http_peak_hour_count",
]
MEAN_FEATURES = ["pc_prior_use_ratio", "pc_is_primary"]
CONTEXT_MAX_FEATURES = ["distinct_pcs_used_prior"]
DISTINCT_FEATURES = ["unique_files_accessed", "unique_recipients", "unique_domains_visited"]
CROSS_MACHINE_FEATURES = [
    "pcs_used_count", "non_primary_pc_used_flag", "non_primary_pc_http_requests_flag",
    "non_primary_pc_usb_flag", "non_primary_pc_file_copy_flag",
]
BASE_FEATURES = [
    "logon_count", "logoff_count", "off_hours_logon", "logon_late_night_count",
    "logon_hourly_entropy", "logon_peak_hour_count", "logon_longest_active_run_minutes",
    "file_open_count", "file_write_count", "file_copy_count", "file_delete_count",
    "unique_files_accessed", "off_hours_files_accessed", "file_late_night_count",
    "file_hourly_entropy", "file_peak_hour_count", "file_longest_active_run_minutes",
    "usb_insert_count", "usb_remove_count", "off_hours_usb_usage", "device_late_night_count",
    "device_hourly_entropy", "device_longest_active_run_minutes",
    "emails_sent", "external_emails_sent", "attachments_sent", "off_hours_emails",
    "unique_recipients", "email_late_night_count", "email_hourly_entropy", "email_peak_hour_count",
    "http_total_requests", "http_visit_count", "http_download_count", "http_upload_count",
    "http_jobsite_visits", "http_cloud_storage_visits", "http_suspicious_site_visits",
    "off_hours_http_requests", "http_long_url_count", "unique_domains_visited",
    "http_late_night_count", "http_hourly_entropy", "http_peak_hour_count",
    "pcs_used_count", "non_primary_pc_used_flag", "non_primary_pc_http_requests_flag",
    "non_primary_pc_usb_flag", "non_primary_pc_file_copy_flag",
]
CROSS_FLAGS = [
    "usb_file_activity_flag", "off_hours_activity_flag", "external_comm_activity_flag",
    "jobsite_usb_activity_flag", "suspicious_upload_flag", "cloud_upload_flag",
    "non_primary_pc_risk_flag",
]
PROFILE_COLUMNS = [
    "employee_name", "department", "role", "supervisor",
    "functional_unit", "is_active", "role_sensitivity",
]
NON_FEATURE_COLUMNS = [
    "user", "day", "pc", "employee_name", "supervisor", "role", "department",
    "functional_unit", "is_active", "role_sensitivity", "baseline_complete",
]
DISPLAY_CHANNELS = {
    "Authentication": ["logon_count", "logoff_count", "off_hours_logon"],
    "File Access": [
        "file_open_count", "file_write_count", "file_copy_count", "file_delete_count",
        "unique_files_accessed", "off_hours_files_accessed",
    ],
    "Removable Media": ["usb_insert_count", "usb_remove_count", "off_hours_usb_usage"],
    "Email": [
        "emails_sent", "unique_recipients", "external_emails_sent", "attachments_sent",
        "off_hours_emails",
    ],
    "HTTP Activity": [
        "http_total_requests", "http_visit_count", "http_download_count", "http_upload_count",
        "http_jobsite_visits", "http_cloud_storage_visits", "http_suspicious_site_visits",
        "off_hours_http_requests", "http_long_url_count", "unique_domains_visited",
    ],
    "PC Activity": CROSS_MACHINE_FEATURES,
}
RAW_FEATURES = [name for names in DISPLAY_CHANNELS.values() for name in names]
SCORE_COLUMNS = [
    "if_anomaly_score", "if_percentile_rank", "if_risk_band", "ae_percentile_rank",
    "ae_risk_band", "composite_score", "composite_risk_band",
]
FAMILY_SUFFIXES = [
    "_zscore_90d", "_peer_zscore", "_1d_over_30d_ratio", "_longest_active_run_minutes",
    "_late_night_count", "_hourly_entropy", "_peak_hour_count", "_rolling_delta",
    "_7d_sum", "_30d_sum", "_zscore",
]
CHANNEL_PREFIXES = {
    "logon": ["logon_", "logoff_", "off_hours_logon"],
    "file": ["file_", "unique_files_", "off_hours_files_"],
    "email": ["emails_", "external_emails_", "attachments_", "off_hours_emails_", "unique_recipients_"],
    "device": ["usb_", "off_hours_usb_"],
    "http": ["http_", "off_hours_http_", "unique_domains_"],
    "pc": ["pc_", "non_primary_pc_", "pcs_used_count", "primary_pc_", "distinct_pcs_", "new_pc_"],
}
CHANNEL_FLAGS = {
    "email": ["external_comm_activity_flag"],
    "device": ["usb_file_activity_flag", "jobsite_usb_activity_flag"],
    "http": ["cloud_upload_flag", "suspicious_upload_flag"],
}
ERROR_CHANNEL_PATTERNS = [
    ("Cross-Channel", "_flag$"),
    ("Auth", "logon|logoff"),
    ("File", "file_|unique_files"),
    ("USB", "usb_|device_"),
    ("Email", "email|attachment|recipient"),
    ("HTTP", "http_|unique_domain"),
    ("PC", "pcs_used|non_primary_pc"),
]

# --- Fixed values: risk bands -------------------------------------------------
BANDS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
PERCENTILE_FLOORS = {"MEDIUM": 80.0, "HIGH": 90.0, "CRITICAL": 95.0}
CALIBRATION_PERCENTILES = {"LOW": 95.0, "MEDIUM": 99.0, "HIGH": 99.5}
DISPOSITIONS = ["NEW", "INVESTIGATING", "RESOLVED", "DISMISSED"]
SENSITIVITY_FLOORS = {"CRITICAL": 0.85, "HIGH": 0.70, "MEDIUM": 0.50}

# --- Fixed values: phrases for feature names ----------------------------------
FEATURE_PHRASES = {
    "off_hours_logon": "after-hours logon activity",
    "off_hours_logon_count": "after-hours logon activity",
    "logon_count": "elevated logon frequency",
    "file_open_count": "high file open activity",
    "file_write_count": "file write activity",
    "file_copy_count": "file copy activity",
    "file_delete_count": "file deletion activity",
    "unique_files_accessed": "access to many unique files",
    "off_hours_files_accessed": "after-hours file access",
    "usb_insert_count": "USB device insertion",
    "usb_remove_count": "USB device removals",
    "off_hours_usb_usage": "after-hours USB usage",
    "usb_file_activity_flag": "USB-related file activity",
    "jobsite_usb_activity_flag": "job-site browsing combined with USB activity",
    "emails_sent": "high email volume",
    "unique_recipients": "many unique email recipients",
    "external_emails": "external email activity",
    "external_email_count": "external email activity",
    "attachements_sent": "email attachment activity",
    "attachments_sent": "email attachment activity",
    "off_hours_emails": "after-hours email activity",
    "off_hours_activity_flag": "off-hours behavioral anomalies",
    "external_comm_activity_flag": "external communication anomalies",
    "http_total_requests": "total web requests",
    "http_visit_count": "web page visits",
    "http_download_count": "web downloads",
    "http_upload_count": "web uploads",
    "http_jobsite_visits": "job-site website visits",
    "http_cloud_storage_visits": "cloud storage website visits",
    "http_suspicious_site_visits": "suspicious website visits",
    "off_hours_http_requests": "after-hours HTTP activity",
    "http_long_url_count": "long-URL HTTP activity",
    "unique_domains_visited": "unique websites visited",
    "suspicious_upload_flag": "suspicious web upload activity",
    "cloud_upload_flag": "cloud storage upload activity",
    "file_delete_count_zscore": "unusually high file deletion activity",
    "file_write_count_zscore": "unusually high file write activity",
    "file_copy_count_zscore": "unusually high file copy activity",
    "file_open_count_zscore": "unusually high file open activity",
    "unique_files_accessed_zscore": "unusually high unique file access",
    "off_hours_files_accessed_zscore": "unusually high after-hours file access",
    "off_hours_logon_zscore": "unusually high after-hours logon activity",
    "http_long_url_count_zscore": "unusually high long-URL HTTP activity",
    "off_hours_http_requests_zscore": "unusually high after-hours HTTP activity",
    "attachments_sent_zscore": "unusually high attachment-sending activity",
    "attachements_sent_zscore": "unusually high attachment-sending activity",
    "external_emails_sent_zscore": "unusually high external email activity",
    "external_email_count_zscore": "unusually high external email activity",
    "emails_sent_zscore": "unusually high email volume",
    "unique_recipients_zscore": "unusually high number of unique email recipients",
    "usb_insert_count_zscore": "unusually high USB insertion activity",
    "http_total_requests_zscore": "unusually high web request volume",
    "http_visit_count_zscore": "unusually high web browsing activity",
    "http_download_count_zscore": "unusually high web download activity",
    "http_upload_count_zscore": "unusually high web upload activity",
    "http_jobsite_visits_zscore": "unusually high job-site browsing activity",
    "http_cloud_storage_visits_zscore": "unusually high cloud storage activity",
    "http_suspicious_site_visits_zscore": "unusually high suspicious site visits",
    "unique_domains_visited_zscore": "unusually high number of unique websites visited",
    "file_delete_count_rolling_delta": "sudden spike in file deletions",
    "file_write_count_rolling_delta": "sudden spike in file write activity",
    "file_copy_count_rolling_delta": "sudden spike in file copy activity",
    "file_open_count_rolling_delta": "sudden spike in file open activity",
    "unique_files_accessed_rolling_delta": "sudden increase in unique file access",
    "off_hours_files_accessed_rolling_delta": "sudden increase in after-hours file access",
    "off_hours_logon_rolling_delta": "sudden increase in after-hours logons",
    "emails_sent_rolling_delta": "sudden spike in email volume",
    "external_emails_rolling_delta": "sudden spike in external email activity",
    "attachments_sent_rolling_delta": "sudden spike in attachment-sending",
    "attachements_sent_rolling_delta": "sudden spike in attachment-sending",
    "usb_insert_count_rolling_delta": "sudden spike in USB device activity",
    "http_requests_rolling_delta": "sudden spike in HTTP requests",
    "off_hours_http_requests_rolling_delta": "sudden increase in after-hours HTTP activity",
    "http_total_requests_rolling_delta": "sudden spike in web requests",
    "http_visit_count_rolling_delta": "sudden spike in web browsing",
    "http_download_count_rolling_delta": "sudden spike in web downloads",
    "http_upload_count_rolling_delta": "sudden spike in web uploads",
    "http_jobsite_visits_rolling_delta": "sudden increase in job-site browsing",
    "http_cloud_storage_visits_rolling_delta": "sudden increase in cloud storage website visits",
    "http_suspicious_site_visits_rolling_delta": "sudden increase in suspicious site visits",
    "http_long_url_count_rolling_delta": "sudden spike in long-URL HTTP activity",
    "unique_domains_visited_rolling_delta": "sudden increase in unique websites visited",
}
BASE_PHRASES = {
    "file_delete_count": "file deletions",
    "file_write_count": "file write activity",
    "file_copy_count": "file copy activity",
    "file_open_count": "file open activity",
    "unique_files_accessed": "unique file access",
    "off_hours_files_accessed": "after-hours file access",
    "off_hours_logon": "after-hours logons",
    "logon_count": "logon frequency",
    "logoff_count": "logoff activity",
    "external_emails": "external email activity",
    "external_email_count": "external email activity",
    "external_emails_sent": "external email activity",
    "http_long_url": "long-URL HTTP activity",
    "off_hours_http": "after-hours HTTP activity",
    "attachments_sent": "attachment-sending activity",
    "attachements_sent": "attachment-sending",
    "emails_sent": "email volume",
    "unique_recipients": "unique email recipients",
    "off_hours_emails": "after-hours email activity",
    "usb_insert_count": "USB device activity",
    "usb_remove_count": "USB device removals",
    "off_hours_usb_usage": "after-hours USB usage",
    "http_requests": "HTTP requests",
    "http_total_requests": "web requests",
    "http_visit_count": "web page visits",
    "http_download_count": "web downloads",
    "http_upload_count": "web uploads",
    "http_jobsite_visits": "job-site browsing",
    "http_cloud_storage_visits": "cloud storage website visits",
    "http_suspicious_site_visits": "suspicious site visits",
    "unique_domains_visited": "unique websites visited",
}

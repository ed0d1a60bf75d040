"""Names kept by the collectors."""

# Server status counters, as the server spells them.
STATUS = (
    "Aborted_clients",
    "Aborted_connects",
    "Bytes_received",
    "Bytes_sent",
    "Com_commit",
    "Com_delete",
    "Com_grant",
    "Com_insert",
    "Com_insert_select",
    "Com_load",
    "Com_replace",
    "Com_replace_select",
    "Com_rollback",
    "Com_rollback_to_savepoint",
    "Com_select",
    "Com_slave_start",
    "Com_slave_stop",
    "Com_truncate",
    "Com_update",
    "Connections",
    "Created_tmp_disk_tables",
    "Created_tmp_files",
    "Created_tmp_tables",
    "Innodb_buffer_pool_reads",
    "Innodb_buffer_pool_read_ahead",
    "Innodb_buffer_pool_read_requests",
    "Innodb_data_fsyncs",
    "Key_read_requests",
    "Key_reads",
    "Key_write_requests",
    "Key_writes",
    "Open_files",
    "Open_table_definitions",
    "Open_tables",
    "Opened_files",
    "Opened_table_definitions",
    "Opened_tables",
    "Queries",
    "Questions",
    "Select_full_join",
    "Select_full_range_join",
    "Select_range",
    "Select_range_check",
    "Select_scan",
    "Slave_open_temp_tables",
    "Slow_launch_threads",
    "Slow_queries",
    "Table_open_cache_hits",
    "Table_open_cache_misses",
    "Table_open_cache_overflows",
    "Threads_cached",
    "Threads_connected",
    "Threads_created",
    "Threads_running",
)

# Table catalogue columns (matched without regard to case) and what stands for NULL.
TABLE_INFO_DEFAULTS = {
    "table_schema": "",
    "table_name": "",
    "table_type": "",
    "engine": "",
    "version": "0",
    "row_format": "0",
    "table_rows": "0",
    "data_length": "0",
    "index_length": "0",
    "data_free": "0",
    "auto_increment": "0",
    "create_options": "",
    "table_comment": "",
}

# Schemas the table collector leaves out.
SYSTEM_SCHEMAS = ("performance_schema", "information_schema", "sys")

# Named rates and the counters each one sums.
RATE_GROUPS = {
    "statements": ("queries",),
    "reads": ("com_select",),
    "transactions": ("com_commit", "com_rollback"),
}

# The cadences samples are taken at.
CADENCES = ("1 second", "1 minute", "5 minutes", "1 hour", "1 day")

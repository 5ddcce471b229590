from chronoframe.sources.tables import (  # noqa: F401
    EVENTS_VOCAB,
    events_as_log,
    events_log,
    load,
    read_table,
    write_table,
)
from chronoframe.sources.csv_sessions import (  # noqa: F401,E402
    merge_sessions,
    path_fields,
    read_kind,
    read_session_dir,
    read_session_files,
    rename_meta,
)

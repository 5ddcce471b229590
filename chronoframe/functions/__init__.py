from chronoframe.functions.scalars import (  # noqa: F401
    clip_values,
    epoch_micros,
    from_epoch_micros,
    in_set,
    label_text,
    marker_size,
    nan_to_null,
    number_text,
    parse_log_ts,
    secs,
    threshold_label,
    to_numeric,
    trunc_ts,
    unit_micros,
)

"""Writers for landed data, processed data and audit logs."""

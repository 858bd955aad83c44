"""Empty on purpose: the engine has no streaming operators; its tables are read and written whole."""

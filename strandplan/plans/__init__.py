"""Session helpers and whole-design orchestration."""

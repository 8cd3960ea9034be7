"""DataFrame-to-DataFrame operators over logs, alerts, incidents, notes and users."""

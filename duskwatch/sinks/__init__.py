"""Writers for alerts, the live feed, the agent registry and notifications."""

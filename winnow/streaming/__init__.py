"""Rollout steps over streaming inputs."""
